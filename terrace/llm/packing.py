"""Packing by concatenate and cut."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm import arrow, bpe, scratch

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, padded_length long, crosses_partition boolean"


def _tokens(path: str, end_id: int):
    schema = pa.schema([("part", pa.int64()), ("local", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, local = TaskContext.get().partitionId(), 0
        vocab, end = bpe.vocabulary(path, library=True), np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids = [vocab.encode_bytes(t) + end for t in arrow.strings(b.column(1))]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = local + np.cumsum(n) - n
            local += int(n.sum())
            # ids of two bytes each, where the vocabulary has no more
            small = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids] if len(vocab.tokens) <= 65536 else ids
            yield arrow.batch(schema, np.full(len(n), part), starts, n, b.column(0), small)

    return run


def _cut(size: int, total: int, wide: bool, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()), ("padded_length", pa.int64()), ("crosses_partition", pa.bool_())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    last = (total - 1) // size if total else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, begin, first, stop, n = (b.column(k).to_pylist() for k in range(5))
            rows: list[tuple] = []
            for d, g, lo, hi, k, raw in zip(doc, begin, first, stop, n, arrow.byte_values(b.column(5))):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                at = 0
                while at < k:
                    sequence, offset = divmod(g + at, size)
                    take = min(size - offset, k - at)
                    piece = ids[at : at + take]
                    length = size if sequence < last else total - last * size
                    padded = length if length & (length - 1) == 0 else size
                    crosses = sequence * size < lo or min((sequence + 1) * size, total) > hi
                    rows.append((d, at, take, zlib.crc32(piece.tobytes()), k, sequence, offset, length, padded, crosses, *([piece.astype("<i4")] if with_ids else [])))
                    at += take
            if rows:
                yield arrow.batch(schema, *map(list, zip(*rows)))

    return run


def pack(df: DataFrame, path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Lays all documents' ids, each with ``end_id`` after it, end to end and cuts every ``size`` ids.

    Pass one encodes, writes each document's ids with its place in its
    partition, and sums each partition; a prefix sum over those totals, one
    row for each partition, gives global offsets. Pass two cuts fixed windows;
    a document that lies over a cut gives a boundary record on either side.
    All sequences but the last are full. The last is padded to ``size`` unless
    its length is a power of two.

    One row for each piece; its ids too, if ``with_ids``. crosses_partition
    marks pieces of sequences that two partitions share. Null and empty texts
    give the end id alone, null document ids stay null, repeated rows are
    packed each, other columns are ignored, and an empty table gives no
    pieces. The ids are written once to the shared folder, so a lost executor
    cannot change the places that pass one dealt.
    """
    spark = df.sparkSession
    scratch.prepare(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = scratch.table(docs.mapInArrow(_tokens(path, end_id), "part long, local long, n long, doc_id long, ids binary"), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("in_part"))
    # One row for each partition of the input: small enough for one task at any size of the input.
    ends = totals.withColumn("hi", F.sum("in_part").over(Window.orderBy("part"))).select(F.col("part").alias("_part"), (F.col("hi") - F.col("in_part")).alias("lo"), "hi")
    total = ends.agg(F.max("hi")).first()[0] or 0
    placed = tokens.join(F.broadcast(ends), F.col("part") == F.col("_part")).select("doc_id", (F.col("lo") + F.col("local")).alias("begin"), "lo", "hi", "n", "ids")
    wide = len(bpe.vocabulary(path).tokens) > 65536
    return placed.mapInArrow(_cut(size, int(total), wide, with_ids), PIECES + (", ids array<int>" if with_ids else ""))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids, gathered from pieces with ids; a group holds one sequence at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"), F.first("padded_length").alias("padded_length"))
