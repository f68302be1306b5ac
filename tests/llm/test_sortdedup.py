import hashlib
from collections import defaultdict

import pytest

from terrace.llm import sortdedup


def lower(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("partitions", [1, 16])
def test_against_brute_force(spark, partitions):
    texts = ["Same Text", "same text", "ÉTÉ", "été", "", None, "x" * 100000, "X" * 100000, "x" * 99999, *["hot"] * 300, *[f"p{'q' * 70}{k % 9}" for k in range(60)]]
    rows = [(k, t, "a") for k, t in enumerate(texts)] + [(7, "dup", "b"), (7, "dup", "b"), (None, "dup", "c"), (None, "alone", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = sortdedup.content_sort_dedup(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[hashlib.sha256(lower(t)).hexdigest()].append(i)
    assert len(out) == len(rows)
    kept = defaultdict(int)
    for r in out:
        ids = groups[r.text_sha256]
        assert r.keep_id == max((i for i in ids if i is not None), default=None) and r.group_size == len(ids)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_empty(spark):
    assert sortdedup.content_sort_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
