import random
import re

import numpy as np
import pytest

from terrace.llm import ngramjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    words = WORD.findall((text or "").encode().lower().decode())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    line = [rng.choice(vocab) for _ in range(60)]
    texts = ["", None, " \t\n", "one two", "One TWO", "one two three", "a b c d e", "a b c d e f", "É é", "é É"]
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 150))]
        if rng.random() < 0.4:
            base = base[:20] + line + base[20:]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    base = [rng.choice(vocab) for _ in range(80)]
    for _ in range(60):  # a large group of near copies
        copy = list(base)
        copy[rng.randrange(80)] = rng.choice(vocab)
        texts.append("  ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("block,elements", [(1500, 2_000_000), (16, 2_000_000), (1500, 900)])
def test_against_brute_force(spark, monkeypatch, block, elements):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "ELEMENTS", elements)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, rep string, n int").repartition(3)
    out = ngramjoin.near_groups(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows)


@pytest.mark.parametrize("block,elements", [(1500, 2_000_000), (16, 2_000_000), (1500, 900)])
def test_counts_all_links(spark, monkeypatch, block, elements):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "ELEMENTS", elements)
    rows = corpus()
    rows += rows[60:70] + [(rows[k][0], rows[k + 1][1]) for k in range(100, 140)] + [(None, rows[61][1])]  # ids with equal and with different texts
    sets = [shingles(t) for _, t in rows]
    alike = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    want = [0 if i is None else sum(k != m and j is not None and alike(sets[k], sets[m]) for m, (j, _) in enumerate(rows)) for k, (i, _) in enumerate(rows)]
    out = ngramjoin.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.n_links) for r in out) == sorted((i or 0, len(s), w) for (i, _), s, w in zip(rows, sets, want))
    assert max(want) > 50


def test_tree_finds_all_components():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sets = []
        for _ in range(rng.integers(1, 8)):
            base = rng.choice(60, rng.integers(1, 25), replace=False)
            sets += [np.unique(np.where(rng.random(len(base)) < 0.1, rng.integers(0, 60, len(base)), base)).astype(np.uint64) for _ in range(4)]
        sets.sort(key=lambda s: s.astype(">u8").tobytes())
        links = ngramjoin.PrefixTree(sets, 80).links()
        label, want = list(range(len(sets))), list(range(len(sets)))

        def join(to, a, b):
            p, q = to[a], to[b]
            to[:] = [p if x == q else x for x in to]

        for a, b in links:
            assert label[a] != label[b]
            join(label, a, b)
        for a in range(len(sets)):
            for b in range(a):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if 100 * len(x & y) >= 80 * len(x | y):
                    join(want, a, b)
        same = lambda to: [[i for i, x in enumerate(to) if x == to[k]] for k in range(len(to))]
        assert same(label) == same(want)


def test_margin_of_the_smallest_set_of_an_id():
    from terrace.llm.suffixdedup import _pack, _unpack

    def table(columns):
        return ngramjoin.pa.table({"bucket": [0], "n": [len(columns[0])], "blob": [_pack(columns)]})

    keys, reps, sizes = np.array([5, 5, *[k for k in range(10, 34) for _ in (1, 2)]], np.uint64), np.array([1, 3] + [1, 2] * 24), np.array([10000] * 2 + [100] * 48)
    met = ngramjoin._meet(80, 1)(table([keys, reps, sizes])).to_pylist()
    leaders, found, times, least = _unpack(met[0]["blob"], met[0]["n"], ngramjoin._MEETINGS_KINDS)
    assert dict(zip(found.tolist(), least.tolist())) == {1: 100, 2: 100, 3: 10000}
    columns = [np.array([1, 1]), np.array([1, 1]), np.array([2, 24], np.int32), np.array([10000, 100])]
    assert ngramjoin._settle(80)(table(columns)).column("rep").to_pylist() == [1]


def test_null_and_shared_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (7, "A b c d e f"), (None, "a b c d e f"), (9, "x y"), (9, None)]
    out = ngramjoin.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in out) == [(-1, 2, -1), (5, 2, 5), (5, 2, 5), (7, 2, 5), (9, 0, 9), (9, 1, 9)]


def test_empty(spark):
    assert ngramjoin.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100, 160)] + [(7, 3), (3, 5)], "a long, b long")
    got = {r.node: r.component for r in ngramjoin.components(edges).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {3: 3, 5: 3, 7: 3}
