import hashlib
import random
import zlib

import numpy as np
import pytest

from terrace.llm import bpe, packing, queries

ODD = ["", " ", "  a", "a  b \n c", "x  y", "don't I'll we're", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "\t\ttabs\n\n\nlines ", "é́ñ 中文 123４५ ²³ Ⅷ", "aaaa" * 300, "🙂🙂 🙂", " 　 z", "Nl ᛮ x_y __", "a\r\nb", "\x00\x01"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


def _texts():
    rng = random.Random(3)
    pool = "ab eE  '\n\t.,!?0123é中🙂_-<|>  sSt"
    return ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 200))) for _ in range(400)]


@pytest.mark.parametrize("library", [False, True])
def test_ids_and_decoding_match_the_library(reference, library):
    own = bpe.ByteBPE(queries.tokenizer_path(), library)
    for t in _texts():
        ids = reference.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == reference.decode(ids, skip_special_tokens=False)
    assert own.decode([129, 130]) == reference.decode([129, 130], skip_special_tokens=False)


def test_cuts_never_fall_inside_a_token(reference):
    own = bpe.ByteBPE(queries.tokenizer_path())
    assert len(own.inside) < 65536
    for t in own.tokens[:2000]:
        assert own.cuts(t) == [t] or t.startswith(b"<|")
    assert own.cuts(b"a\x00\x01b")[0] == b"a"


def test_query_on_odd_rows(spark, reference):
    texts = [*_texts()[:60], None, "word " * 30000]
    df = spark.createDataFrame([(k if k else None, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    for r in bpe.encode_decode(df, queries.tokenizer_path()).collect():
        text = texts[r.doc_id or 0] or ""
        ids = reference.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids == ids and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_packing_is_gapless(spark, reference, parts):
    texts = [*_texts()[:80], None, "word " * 9000, "twice", "twice"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(parts)
    rows = packing.pack(df, queries.tokenizer_path(), size=64).collect()
    ids = [reference.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    by_doc, by_seq = {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == piece and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length))
    for k, want in enumerate(ids):
        at = 0
        for start, length in sorted(by_doc[k]):
            assert start == at
            at += length
        assert at == len(want)
    total = sum(map(len, ids))
    assert sorted(by_seq) == list(range(-(-total // 64)))
    for k, pieces in by_seq.items():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at == pieces[0][2] == min(64, total - 64 * k)
    whole = packing.sequences(packing.pack(df, queries.tokenizer_path(), size=64)).collect()
    assert sum(len(r.ids) for r in whole) == total
    assert packing.pack(df.limit(0), queries.tokenizer_path()).count() == 0


def test_memo_keeps_what_is_in_use():
    made = []
    memo = bpe._Memo(lambda k: made.append(k) or k, size=2)
    assert [memo[k] for k in "abacada"] == list("abacada")
    assert made == list("abcd")
    long = "z" * (bpe.LONGEST_KEY + 1)
    assert memo[long] == long and memo[long] == long and made[4:] == [long, long] and long not in memo
