"""Exact deduplication by content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import arrow, scratch

#: Bytes of normalised content that the splitters see; the digest breaks their ties.
PREFIX = 64


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("prefix", pa.binary()), ("digest", pa.binary()), ("body", pa.binary())])
    for b in batches:
        bodies = [x.lower() for x in arrow.byte_values(b.column(1))]  # bytes.lower() changes A-Z only
        yield arrow.batch(schema, b.column(0), [x[:PREFIX] for x in bodies], [hashlib.sha256(x).digest() for x in bodies], bodies)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in content order: runs of equal bodies, those at the partition's edges marked."""
    schema = pa.schema([("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string()), ("head", pa.bool_()), ("edge", pa.bool_())])
    body = digest = None
    ids: list = []
    first = True

    def flush(edge: bool) -> pa.RecordBatch:
        n = len(ids)
        return arrow.batch(schema, ids, pa.repeat(pa.scalar(ids[0], pa.int64()), n), pa.repeat(pa.scalar(n, pa.int64()), n), pa.repeat(digest.hex(), n), [True] + [False] * (n - 1), pa.repeat(edge, n))

    waiting: list[pa.RecordBatch] = []
    for b in batches:
        for doc_id, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), arrow.byte_values(b.column(2))):
            if body is not None and x == body:
                ids.append(doc_id)
                continue
            if body is not None:
                waiting.append(flush(first))
                first = False
            body, digest, ids = x, d, [doc_id]
        if len(waiting) > 1000:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting = []
    if body is not None:
        waiting.append(flush(True))
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def content_sort_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z; the row with the largest id stays.

    Sampled splitters over (first bytes, digest, id) deal the normalised bytes
    out by range, so the copies of one text, however many, spread over
    partitions; sorting inside each, with spill, places equals side by side,
    and neighbours are compared in full. A run that touches an edge of its
    partition may go on in the next: those runs, two for each partition at
    most, are joined by digest.

    One row for each input row: doc_id, keep_id, group_size, kept,
    text_sha256. Null texts count as empty, and empty texts equal each other.
    A null id is smaller than any other; of rows that share text and id, one
    is kept. Only the two named columns are read; an empty table gives none.
    """
    spark = df.sparkSession
    scratch.prepare(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_normalise, "doc_id long, prefix binary, digest binary, body binary")
    dealt = rows.repartitionByRange(F.col("prefix"), F.col("digest"), F.col("doc_id").desc_nulls_last())
    ordered = dealt.sortWithinPartitions(F.col("prefix"), F.col("digest"), F.col("doc_id").desc_nulls_last())
    runs = ordered.select("doc_id", "digest", "body").mapInArrow(_neighbours, "doc_id long, keep_id long, group_size long, text_sha256 string, head boolean, edge boolean")
    runs = scratch.table(runs, "content-runs")
    whole = runs.where("edge and head").groupBy("text_sha256").agg(F.max("keep_id").alias("keep"), F.sum("group_size").alias("size"))
    columns = ["doc_id", "keep_id", "group_size", (F.col("head") & F.col("keep_id").eqNullSafe(F.col("own"))).alias("kept"), "text_sha256"]
    edges = runs.where("edge").withColumnRenamed("keep_id", "own").join(whole, "text_sha256")
    edges = edges.select("doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "head", "own", "text_sha256")
    return runs.where("not edge").withColumn("own", F.col("keep_id")).select(columns).unionByName(edges.select(columns))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in content order: the first of each run, with a digest where the run touches an edge of its partition."""
    body = held = None  # of the last run: its text, and its first row as a batch of one
    first = True

    def rows(b: pa.RecordBatch, at: list[int], edges: list[bytes | None]) -> pa.RecordBatch:
        schema = pa.schema([b.schema.field(0), b.schema.field(1), pa.field("edge", pa.binary())])
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), pa.array(edges, pa.binary())], schema=schema)

    for b in batches:
        bodies = [x.lower() for x in arrow.byte_values(b.column(2))]
        new = [k for k, x in enumerate(bodies) if x != (bodies[k - 1] if k else body)]
        if not new:
            continue
        if held is not None:
            yield rows(held, [0], [hashlib.sha256(body).digest() if first else None])
            first = False
        if len(new) > 1:
            yield rows(b, new[:-1], [hashlib.sha256(bodies[k]).digest() if first and k == new[0] else None for k in new[:-1]])
            first = False
        body, held = bodies[new[-1]], b.slice(new[-1], 1)
    if held is not None:
        yield rows(held, [0], [hashlib.sha256(body).digest()])


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, that ``content_sort_dedup`` keeps.

    One range shuffle carries whole rows. In content order the first row of a
    run of equal texts has its largest id; of runs that touch an edge of
    their partition, two for each partition at most, those with a larger or
    equal id before them go, by digest. Null ids are smaller than all others;
    of rows that share text and id, one stays. Null texts count as empty.
    Columns may have any names; an empty table stays empty.
    """
    spark = df.sparkSession
    scratch.prepare(spark)
    text = F.col(f"`{text_col}`").cast("string")

    @F.pandas_udf("prefix binary, digest binary")
    def keys(texts):
        import pandas as pd

        bodies = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        return pd.DataFrame({"prefix": [x[:PREFIX] for x in bodies], "digest": [hashlib.sha256(x).digest() for x in bodies]})

    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), keys(text).alias("key"))
    order = [F.col("key.prefix"), F.col("key.digest"), F.col("id").desc_nulls_last()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "id", "text")
    out = ordered.select("row", "id").schema.add("edge", "binary")
    heads = scratch.table(ordered.mapInArrow(_heads, out), "content-heads")
    ranked = heads.where("edge IS NOT NULL").withColumn("place", F.struct(F.col("id").isNotNull(), F.col("id"), F.monotonically_increasing_id()))
    best = ranked.groupBy("edge").agg(F.max_by("row", "place").alias("row"))
    return heads.where("edge IS NULL").select("row.*").unionByName(best.select("row.*"))
