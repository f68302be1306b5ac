import hashlib
import random

import numpy as np
import pytest

from terrace.llm import suffixdedup

N = suffixdedup.LENGTH


def brute(rows):
    first = {}
    low = -(1 << 63)
    key = lambda i: low if i is None else i
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - N + 1):
            g = raw[s : s + N]
            first[g] = min(first.get(g, 1 << 63), key(i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - N + 1):
            if first[raw[s : s + N]] < key(i):
                gone[s : s + N] = b"\1" * N
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((-1 if i is None else i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    passages = ["".join(word() for _ in range(n)) for n in (9, 10, 11, 12, 14, 30, 60)]
    texts = ["", None, "short", "a" * 200, "a" * 49, "a" * 50, "ab" * 90, "b" + "ab" * 40]
    for _ in range(120):
        parts = ["".join(word() for _ in range(rng.randint(0, 20)))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 6)
            parts += [p[a : len(p) - rng.randint(0, 6)], word()]
        texts.append("".join(parts))
    texts += rng.sample([t for t in texts if t], 30)
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("chunk,bits", [(suffixdedup.CHUNK, suffixdedup.BITS), (128, 48), (128, 16), (1 << 12, 8), (1 << 12, 64)])
def test_against_brute_force(spark, chunk, bits):
    rows = corpus()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kind string, id int").repartition(5)
    out = suffixdedup.remove_repeats(df, chunk=chunk, bits=bits).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute(rows)
    for r in out:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.removed) == r.n_removed


def test_long_texts_are_cut_into_chunks():
    text = np.frombuffer(random.Random(2).randbytes(1000), np.uint8)
    key, owner, lo, count = suffixdedup.find_blocks(text, np.array([300, 700]), 128)
    windows = sorted((int(o), int(a) + k) for o, a, n in zip(owner, lo, count) for k in range(n))
    assert windows == [(0, s) for s in range(251)] + [(1, s) for s in range(651)]


def test_equal_windows_have_equal_keys():
    rng = random.Random(4)
    text = "".join(rng.choice(["a" * 40, "ab" * 30, "abc" * 25, "xyzzy", "b"]) for _ in range(300)).encode()
    data = np.frombuffer(text, np.uint8)
    seen = {}
    for sizes in ([len(text)], [1000, 777, len(text) - 1777]):
        key, owner, lo, count = suffixdedup.find_blocks(data, np.array(sizes), 512)
        first = np.cumsum(sizes) - sizes
        for k, o, a, n in zip(key.tolist(), owner, lo, count):
            for s in range(first[o] + a, first[o] + a + n):
                assert seen.setdefault(text[s : s + N], k) == k
    _, _, _, count = suffixdedup.find_blocks(np.frombuffer(b"a" * 10_000, np.uint8), np.array([10_000]))
    assert len(count) < 1000


def test_refinement_against_plain_comparison():
    rng = random.Random(6)
    base = bytes(rng.choice(b"ab") for _ in range(400))
    pieces, ids = [], []
    for k in range(60):
        a, n = rng.randint(0, 310), rng.randint(N, N + 30)
        piece = bytearray(base[a : a + n])
        if rng.random() < 0.6:
            piece[rng.randrange(n)] = rng.choice(b"abc")
        pieces.append(bytes(piece))
        ids.append(rng.randint(0, 20))
    least = {}
    for p, i in zip(pieces, ids):
        for s in range(len(p) - N + 1):
            least[p[s : s + N]] = min(least.get(p[s : s + N], 99), i)
    size = np.array([len(p) for p in pieces])
    first = np.cumsum(size) - size
    at, piece = suffixdedup.refine(np.frombuffer(b"".join(pieces), np.uint8), size, np.array(ids))
    expected = [(k, s) for k, (p, i) in enumerate(zip(pieces, ids)) for s in range(len(p) - N + 1) if least[p[s : s + N]] < i]
    assert sorted(zip(piece.tolist(), (at - first[piece]).tolist())) == expected


def test_shared_and_null_ids(spark):
    p, q = "passage number one that is longer than fifty bytes for sure", "another passage that is longer than fifty bytes, certainly so"
    rows = [(3, p), (3, p), (3, q + p), (4, p + q), (None, "zz" + q), (None, q), (9, None)]
    out = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute(rows)


def test_empty(spark):
    assert suffixdedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
