"""The corpus pipeline: stages that call operators of ``terrace.llm`` in turn.

Each stage takes what its predecessor kept, with the columns of ``documents``,
and its decisions take effect: rejected rows go, secrets are cut out. The last
stage returns pieces of packed sequences. Null and empty texts pass all stages
as texts without words and are packed as an end token; rows without an id stay
unless an exact copy stays; an empty table gives no pieces; further columns are
kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import ngramjoin, packing, queries, scratch, secrets, sortdedup, toxicity

#: By input and place in the pipeline: what a stage wrote for its result, which may not have been read yet.
_left: dict[tuple[str, int], list[str]] = {}


def _stage(place: int) -> Callable:
    """When a stage begins, its predecessor's result has been written: what that one still needed goes."""

    def wrap(f: Callable) -> Callable:
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            scratch.drop(spark, _left.pop((sf_dir, place - 1), []))
            before = set(scratch.made)
            out = f(spark, docs, sf_dir)
            _left[sf_dir, place] = [p for p in scratch.made if p not in before]
            return out

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        return run

    return wrap


@_stage(0)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the ordinal model on a bounded sample of labelled documents; toxic ones go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


@_stage(1)
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return sortdedup.drop_copies(docs)


@_stage(2)
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the smallest id stays."""
    return ngramjoin.drop_near_copies(docs, n=5, percent=80)


@_stage(3)
def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@_stage(4)
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, queries.tokenizer_path(), size=2048, end_id=1, with_ids=False)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("secret_scan", cut_secrets), ("packing", pack)]

#: SQL can express neither the fitted model nor byte-level BPE; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each result written and read again."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = scratch.folder(spark, f"stage-{name}")
        out.write.parquet(path)
        scratch.drop(spark, read)
        docs, read = spark.read.schema(out.schema).parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
