"""Document fingerprints: quartile digests of hashed byte triplets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import arrow, scratch

BUCKETS = 256
#: Difference of two quartile codes that are 0, 1, 2 or 3 apart.
COSTS = np.array([0, 1, 3, 6])
#: Difference for each step of the length code, and at most.
LENGTH_COST, LENGTH_MOST = 4, 96
MOST = BUCKETS * int(COSTS[-1]) + LENGTH_MOST

_LOWEST = -(1 << 63)


def _tables() -> np.ndarray:
    """Three fixed permutations of the bytes, from a multiplicative generator."""
    out, x = [], 88172645463325252
    for _ in range(3):
        order = list(range(256))
        for i in range(255, 0, -1):
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            j = (x >> 33) % (i + 1)
            order[i], order[j] = order[j], order[i]
        out.append(order)
    return np.array(out, np.uint8)


_T = _tables()


def digest(text: bytes) -> str:
    """Length code, then two bits for each bucket: the quartile of its triplet count."""
    b = np.frombuffer(text, np.uint8)
    if len(b) < 3:
        counts = np.zeros(BUCKETS, np.int64)
    else:
        counts = np.bincount(_T[0][b[:-2]] ^ _T[1][b[1:-1]] ^ _T[2][b[2:]], minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = (codes << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    length = min(255, int(8 * math.log2(len(b) + 1)))
    return f"{length:02x}" + packed.tobytes().hex()


def difference(a: str, b: str) -> int:
    """Bounded by MOST; 0 for equal fingerprints."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    codes = [(v[1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3 for v in (x, y)]
    apart = np.abs(codes[0].astype(np.int8) - codes[1].astype(np.int8))
    return int(COSTS[apart].sum()) + min(LENGTH_MOST, LENGTH_COST * abs(int(x[0]) - int(y[0])))


def likeness(a: str, b: str) -> float:
    return 1 - difference(a, b) / MOST


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of each text; null counts as empty. One narrow pass."""
    scratch.prepare(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield arrow.batch(schema, b.column(0), [digest(t) for t in arrow.byte_values(b.column(1))])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dest, extra, doc_id, text) in order; each own row is compared with the row after it."""
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(fields)

    def row(doc_id, text, mark, after, after_mark):
        half = len(text) // 2
        edited = (text[: len(text) - half] + after[:half]).encode()
        edited_mark = digest(edited)
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, after_mark)

    held, place = None, None
    for b in batches:
        out = []
        for dest, extra, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), arrow.strings(b.column(3))):
            if held is None and extra:
                continue  # the next document is already found
            mark = digest(text.encode())
            if held is not None and place == dest:
                out.append(row(*held, text, mark))
            held, place = None if extra else (doc_id, text, mark), dest
        if out:
            yield arrow.batch(schema, *map(list, zip(*out)))


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints each text and its edited text, whose tail is the beginning of the next document.

    Next is the row of the next larger id, and after the last the first; rows
    of one id follow each other by text, null ids come first, and a table of
    one row is its own next. Null texts count as empty. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. Only the two named columns are read.

    Sampled splitters deal documents out by id range, once; the first of each
    range, one row for each partition, also goes to the range before it. So
    every pair meets in one task, and no row needs a global order.
    """
    spark = df.sparkSession
    scratch.prepare(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = F.coalesce("doc_id", F.lit(_LOWEST))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # n - 1 numbers
    quantiles = docs.select(F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    splitters = np.array(sorted(set(quantiles)), np.int64)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("first", pa.int64())])
        for b in batches:
            ids = b.column(0).fill_null(_LOWEST).to_numpy()
            yield arrow.batch(schema, np.searchsorted(splitters, ids, "right").astype(np.int32), ids)

    found = docs.select("doc_id").mapInArrow(ranges, "part int, first long").groupBy("part").agg(F.min("first").alias("first")).collect()
    firsts = sorted((r["part"], r["first"]) for r in found)  # one for each partition
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dest", pa.int32()), ("extra", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.string())])
        marks = np.array(sorted(before), np.int64)
        for b in batches:
            ids = b.column(0).fill_null(_LOWEST).to_numpy()
            text = b.column(1).cast(pa.string())
            yield arrow.batch(schema, np.searchsorted(splitters, ids, "right").astype(np.int32), np.zeros(len(ids), bool), b.column(0), text)
            at = np.flatnonzero(np.isin(ids, marks))
            if len(at):
                yield arrow.batch(schema, np.array([before[int(i)] for i in ids[at]], np.int32), np.ones(len(at), bool), b.column(0).take(pa.array(at)), text.take(pa.array(at)))

    rows = docs.mapInArrow(deal, "dest int, extra boolean, doc_id long, text string")
    rows = rows.repartitionById(n, F.col("dest")) if hasattr(rows, "repartitionById") else rows.repartition(n, "dest")
    ordered = rows.sortWithinPartitions("dest", "extra", "doc_id", "text")
    return ordered.mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
