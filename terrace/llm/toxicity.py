"""Toxicity: cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import arrow, scratch
from terrace.llm.bpe import _Memo

#: Labelled rows that a model is fitted on, at most: those of the smallest hashes of their ids.
SAMPLE = 12_000
#: Hashed features.
WIDTH = 1 << 18
#: P(grade >= 1) from which a text counts as toxic; of 0.15, 0.2, 0.25 and 0.3 the least with 1 % false alarms at most, by
#: cross-validation on the development split.
TOXIC_FROM = 0.25
STRIP = ".,;:!?|\"'()[]{}<>#$%&*-_"


def word_features(word: str) -> list[int]:
    """Places of a word and of its first four to six letters."""
    raw = word.encode("utf-8", "surrogatepass")
    parts = [b"w:" + raw] + [b"%d:" % n + word[:n].encode("utf-8", "surrogatepass") for n in (4, 5, 6) if len(word) > n]
    return [zlib.crc32(p) % WIDTH for p in parts]


def distinct_words(text: str) -> set[str]:
    words = {w.strip(STRIP) for w in text.lower().split()}
    words.discard("")
    return words


@dataclass
class OrdinalModel:
    """P(grade > j) = sigmoid(score - cuts[j]); one weight vector for all cuts."""

    weights: np.ndarray
    cuts: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(score)[:, None] - self.cuts, -500, 500)))


def telling_features(rows: list[np.ndarray], toxic: np.ndarray, least: float = 2.0, rows_with: int = 2) -> np.ndarray:
    """Marks features of ``rows_with`` toxic rows or more whose share of toxic rows exceeds that of others by ``least`` standard errors."""
    n1, n0 = max(int(toxic.sum()), 1), max(int((toxic == 0).sum()), 1)
    counts = [np.zeros(WIDTH), np.zeros(WIDTH)]
    for r, t in zip(rows, toxic):
        counts[int(t > 0)][np.unique(r)] += 1
    p0, p1, p = counts[0] / n0, counts[1] / n1, (counts[0] + counts[1]) / (n0 + n1)
    error = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n0 + 1 / n1))
    return (p1 - p0 >= least * error) & (counts[1] >= rows_with)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = 400, l2: float = 1e-4, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with a ridge, by full-batch Adam: the same rows give the same model."""
    weights = np.zeros(WIDTH)
    telling = telling_features(rows, grades > 0)
    rows = [r[telling[r]] for r in rows]
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, place = np.unique(at, return_inverse=True)
    w, first = np.zeros(len(used)), np.bincount(grades, minlength=n_grades).astype(float)
    tail = np.clip(1 - np.cumsum(first)[:-1] / first.sum(), 1e-4, 1 - 1e-4) if first.any() else np.full(n_grades - 1, 1e-4)
    cuts = np.log(1 / tail - 1)  # where the score is 0, the grades' shares
    params = [w, cuts]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n = max(len(rows), 1)
    for step in range(1, steps + 1):
        score = np.bincount(which, w[place], minlength=n)[: len(rows)]
        low = np.concatenate([[-np.inf], cuts, [np.inf]])
        with np.errstate(over="ignore"):
            upper, lower = 1 / (1 + np.exp(-(low[grades + 1] - score))), 1 / (1 + np.exp(-(low[grades] - score)))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_score = du - dl  # of -log p
        g_w = np.bincount(place, d_score[which], minlength=len(used)) / n + l2 * w
        g_c = np.array([dl[grades == j + 1].sum() - du[grades == j].sum() for j in range(len(cuts))]) / n
        for k, g in enumerate((g_w, g_c)):
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            params[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        cuts.sort()
    weights[used] = w
    return OrdinalModel(weights, cuts)


def grade(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Severity 0, 1 or 2: toxic rows whose share of telling features is at least the toxic median are 2.

    Labels know toxic and not; the second threshold is derived from the same
    texts, so p_severe orders texts by how much of them is telling and is no
    judgement of its own. A feature tells where it occurs in toxic rows at ten times its rate in others.
    """
    doc_count = [np.bincount(np.concatenate([np.unique(r) for r, t in zip(rows, toxic) if t == k] or [np.zeros(0, np.int64)]), minlength=WIDTH) for k in (0, 1)]
    rate = [(c + 0.5) / (np.sum(toxic == k) + 1) for k, c in enumerate(doc_count)]
    telling = rate[1] > 10 * rate[0]
    share = np.array([telling[r].mean() if len(r) else 0.0 for r in rows])
    out = toxic.astype(np.int64)
    if out.any():
        out[(toxic == 1) & (share >= np.median(share[toxic == 1]))] = 2
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fits on ``sample`` labelled documents at most; their features, not their texts, reach the driver.

    Labels without an id or a grade are left out; of several labels of an id
    the highest counts. Of rows that share an id, the one whose features sort
    first counts; null and empty texts have no features; texts are read whole,
    whatever their length. Without labels, or without documents, the model
    calls nothing toxic.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id IS NOT NULL AND _toxic IS NOT NULL")
    picked = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # ``sample`` rows of two numbers each: a fixed bound.
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("toxic", pa.int32()), ("at", pa.binary())])
        for b in batches:
            at = [np.array(sorted(f for w in distinct_words(t) for f in word_features(w)), "<u4").tobytes() for t in arrow.strings(b.column(1))]
            yield arrow.batch(schema, b.column(0), b.column(2), at)

    found = texts.select("_id", "text", "_toxic").mapInArrow(features, "id long, toxic int, at binary")
    # one row for each of ``sample`` ids at most
    got = sorted(found.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("at").alias("at")).collect(), key=lambda r: r["id"])
    rows = [np.frombuffer(r["at"], "<u4") for r in got]
    toxic = np.array([min(1, r["toxic"]) for r in got], np.int64)
    return fit(rows, grade(rows, toxic), 3)


class _Scorer:
    def __init__(self, model: OrdinalModel):
        self.model = model
        weights = model.weights
        self.memo = _Memo(lambda w: float(sum(weights[f] for f in word_features(w))))
        self.clean = _Memo(lambda w: w.strip(STRIP))

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for k, t in enumerate(texts):
            words = set(map(self.clean.__getitem__, set(t.lower().split())))
            words.discard("")
            out[k] = sum(map(self.memo.__getitem__, sorted(words)))
        return out


_LOADED: dict[int, _Scorer] = {}


def _scorer(shared) -> _Scorer:
    """One scorer for each worker process and broadcast model."""
    if shared.value["key"] not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.value["key"]] = _Scorer(OrdinalModel(shared.value["weights"].astype(float), shared.value["cuts"]))
    return _LOADED[shared.value["key"]]


def _share(spark, model: OrdinalModel):
    """Weights in single precision: WIDTH numbers, whatever the input's size."""
    key = f"{zlib.crc32(model.weights.tobytes())}:{model.cuts.tolist()}"
    return spark.sparkContext.broadcast({"key": key, "weights": model.weights.astype(np.float32), "cuts": model.cuts})


def rate(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Severity of each text: doc_id, p_mild, p_severe, expected_severity, toxic.

    p_mild is P(grade >= 1), p_severe P(grade >= 2); expected_severity is
    their sum, from 0 to 2; toxic where p_mild is at least TOXIC_FROM. Null and
    empty texts score as texts without features. Rows are rated one by one,
    without a shuffle; ids may repeat or be null; other columns are ignored.
    """
    spark = df.sparkSession
    scratch.prepare(spark)
    shared = _share(spark, model)
    schema = pa.schema([("doc_id", pa.int64()), ("p_mild", pa.float64()), ("p_severe", pa.float64()), ("expected_severity", pa.float64()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for b in batches:
            above = scorer.model.above(scorer.scores(arrow.strings(b.column(1))))
            yield arrow.batch(schema, b.column(0), above[:, 0], above[:, 1], above.sum(1), above[:, 0] >= TOXIC_FROM)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, p_mild double, p_severe double, expected_severity double, toxic boolean")


def drop_toxic(df: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, that ``rate`` does not call toxic.

    Null and empty texts, null and repeated ids and columns of any names are
    as in ``rate``; an empty table stays empty.
    """
    spark = df.sparkSession
    scratch.prepare(spark)
    shared = _share(spark, model)

    @F.pandas_udf("boolean")
    def toxic(texts):
        import pandas as pd

        scorer = _scorer(shared)
        return pd.Series(scorer.model.above(scorer.scores([t or "" for t in texts]))[:, 0] >= TOXIC_FROM)

    return df.where(~toxic(F.col(text_col).cast("string")))
