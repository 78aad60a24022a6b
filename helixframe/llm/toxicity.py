"""Toxicity scores from a linear classifier over character n-grams.

Features are the character n-grams of the lower-cased text (white space runs are one
space, one stands at each end), hashed into ``BUCKETS`` buckets and counted as present
or absent.  Each is scaled by its naive Bayes log-count ratio on the labelled texts;
ratios that chance explains (less than ``SIGNIFICANT`` standard errors) are nought, so
long texts gather no noise.  A logistic regression is fitted over the scaled features.

The fit reads at most ``MOST_TRAINING`` texts, those of least id hash among the documents
that have a label; the driver gets two counts a bucket and the significant features of
those texts.  All significant buckets have a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe.llm.common import discard, materialize, texts_of
from helixframe.shipping import arrow_map

LENGTHS = (4, 5, 6)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Most labelled texts that the fit reads.
MOST_TRAINING = 20_000
SMOOTHING, SIGNIFICANT = 0.5, 18.0
RIDGE, STEPS, TOLERANCE = 1e-3, 200, 1e-5
#: Labelled texts whose features the fit unpacks at once.
CHUNK = 1000
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> np.ndarray:
    """Buckets of all character n-grams of a text, with repeats."""
    codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    out, run = [], codes
    for n in range(2, LENGTHS[-1] + 1):
        if len(codes) < n:
            break
        run = run[:-1] * _PRIME + codes[n - 1 :]
        if n in LENGTHS:
            out.append(((run + np.uint64(n)) * _MIX >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This partition's counts: for each bucket the texts of either label that hold it."""
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        for text, label in zip(texts_of(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            counts[label, np.unique(grams(text))] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "n0", "n1"])


@dataclass(frozen=True)
class Model:
    """Weight of each bucket (ratio times coefficient; nought for most) and the bias; without weights nothing is toxic."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.float64)
        out[self.buckets] = self.weights
        return out


def log_count_ratios(n0: np.ndarray, n1: np.ndarray, texts0: int, texts1: int) -> np.ndarray:
    """Naive Bayes log-count ratios of presence, smoothed."""
    return np.log((n1 + SMOOTHING) / (texts1 + 2 * SMOOTHING)) - np.log((n0 + SMOOTHING) / (texts0 + 2 * SMOOTHING))


def g_statistic(n0, n1, texts0: int, texts1: int):
    """Column: G of the table of label by presence, n0 of texts0 and n1 of texts1 texts holding the bucket."""

    def term(x, expected):
        return F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))

    share = (n0 + n1) / float(texts0 + texts1)
    rest = F.greatest(F.lit(1e-12), 1 - share)
    return 2 * (term(n0, share * texts0) + term(n1, share * texts1) + term(texts0 - n0, rest * texts0) + term(texts1 - n1, rest * texts1))


def _logistic(columns: np.ndarray, sizes: np.ndarray, ratios: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression over a sparse matrix; the optimum by limited-memory BFGS, deterministic.

    Row i has ``sizes[i]`` of the ``columns``; the value in a column is its ratio.  Rows are
    gone through in chunks, so that nothing but the columns is held for all of them.
    """
    width, n, ends = len(ratios), len(labels), np.concatenate([[0], np.cumsum(sizes)])

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope, v = 0.5 * RIDGE * float(x[:-1] @ x[:-1]), np.zeros(width + 1), x[:-1] * ratios
        for a in range(0, n, CHUNK):
            b = min(n, a + CHUNK)
            own, count = columns[ends[a] : ends[b]], sizes[a:b]
            z = x[-1] + np.bincount(np.repeat(np.arange(b - a), count), weights=v[own], minlength=b - a)
            wrong = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[a:b]
            value += float((np.logaddexp(0, z) - labels[a:b] * z).sum()) / n
            slope[:-1] += np.bincount(own, weights=np.repeat(wrong, count), minlength=width)
            slope[-1] += wrong.sum()
        slope /= n
        slope[:-1] = slope[:-1] * ratios + RIDGE * x[:-1]
        return value, slope

    x = np.append(np.zeros(width), base_rate(n - labels.sum(), labels.sum()))
    value, slope = objective(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(slope).max() <= TOLERANCE:
            break
        way, kept = slope.copy(), []
        for dx, dg in reversed(moves):
            k = float(dx @ way) / float(dx @ dg)
            kept.append(k)
            way -= k * dg
        if moves:
            dx, dg = moves[-1]
            way *= float(dx @ dg) / float(dg @ dg)
        for (dx, dg), k in zip(moves, reversed(kept), strict=True):
            way += dx * (k - float(dg @ way) / float(dx @ dg))
        step, fall = (1.0 if moves else min(1.0, 1 / np.abs(way).sum())), float(slope @ way)
        while True:
            other, other_slope = objective(x - step * way)
            if other <= value - 1e-4 * step * fall or step < 1e-12:
                break
            step /= 2
        dx, dg = -step * way, other_slope - slope
        x, value, slope = x + dx, other, other_slope
        if float(dx @ dg) > 1e-14:
            moves = [*moves[-9:], (dx, dg)]
    return x[:-1], float(x[-1])


def base_rate(n0: float, n1: float) -> float:
    """Log-odds of the base rate, smoothed; as many of either label are taken for fewer toxic ones."""
    return float(np.log((n1 + 0.5) / (n0 + 1.0)))


def fit(labelled: DataFrame) -> Model | None:
    """Fit on ``(doc_id, text, label)`` with label 0 or 1; None without both labels, which leaves nothing to tell apart.

    The caller bounds the ids.  Of an id with several texts the one of least hash is read, with the id's greatest label.
    """
    own = labelled.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.max("label").cast("int").alias("label"))
    texts = materialize(own.select("doc_id", F.col("t.text").alias("text"), "label"), "training")
    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        discard(texts)
        return None

    counted = arrow_map(texts.select("text", "label"), _presence, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    marked = counted.withColumn("g", g_statistic(F.col("n0"), F.col("n1"), n0, n1)).where(F.col("g") >= SIGNIFICANT)
    table = sorted(tuple(r) for r in marked.select("bucket", "n0", "n1").collect())  # at most BUCKETS rows
    buckets, k0, k1 = (np.array(c, dtype=np.int64) for c in (zip(*table, strict=True) if table else ((), (), ())))
    ratios = log_count_ratios(k0, k1, n0, n1)
    if not len(buckets):
        discard(texts)
        return Model(np.empty(0, dtype=np.int64), np.empty(0), base_rate(n0, n1))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(BUCKETS, -1, dtype=np.int64)
        slot[buckets] = np.arange(len(buckets))
        for batch in batches:
            found = []
            for text in texts_of(batch.column("text")):
                own = slot[grams(text)]
                found.append(np.unique(own[own >= 0]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "found"])

    rows = arrow_map(texts, present, "doc_id long, label int, found binary").orderBy("doc_id", "label").collect()  # `most` texts at most
    labels = np.array([r["label"] for r in rows], dtype=np.float64)
    sizes = np.array([len(r["found"]) // 4 for r in rows])
    columns = np.frombuffer(b"".join(r["found"] for r in rows), dtype=np.int32)
    del rows
    weights, bias = _logistic(columns, sizes, ratios, labels)
    discard(texts)
    return Model(buckets, weights * ratios, bias)


def score(docs: DataFrame, model: Model | None, keep_text: bool = True) -> DataFrame:
    """``docs`` with a column ``score`` from the whole ``text``; a null text counts as empty.

    A column ``score`` of ``docs`` is replaced; without ``keep_text`` the texts are left out.  Without a model nothing is known of toxic texts and every score is 0.
    """
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weights, bias = own.dense(), own.bias
        used = weights != 0
        for batch in batches:
            out = []
            for text in texts_of(batch.column("text")):
                found = grams(text)
                z = bias + weights[np.unique(found[used[found]])].sum()
                out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            passed = [(c, batch.column(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*(x for _, x in passed), pa.array(np.array(out, dtype=np.float64))], names=[*(c for c, _ in passed), "score"])

    columns = [c for c in docs.columns if c != "score"] if keep_text else [c for c in docs.columns if c not in ("score", "text")]
    schema = StructType([docs.schema[c] for c in columns]).add("score", "double")
    return arrow_map(docs.select(*(c for c in docs.columns if c != "score")), run, schema)


def held_out(doc_id):
    """Rows from which no label is learnt: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnt(labels: DataFrame, corpus: DataFrame, most: int = MOST_TRAINING) -> Model | None:
    """The model of the documents of ``corpus`` with a label 0 or 1 in ``labels.toxic`` that are not held out.

    Labels without a document count for nothing: they are joined to the documents' ids before ``most`` cuts them.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    source = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    present = source.select("doc_id").distinct()
    chosen = marks.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most)
    chosen = materialize(chosen, "labelled")  # at most `most` rows
    model = fit(source.join(F.broadcast(chosen), "doc_id"))
    discard(chosen)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, most: int = MOST_TRAINING) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Labels are learnt from the rows of ``corpus`` (``docs`` where not given) that have a
    label of 0 or 1 in ``labels.toxic`` and are not held out.  Only texts are features, and
    every row is scored by its own text, also where ids are shared.  Null ids, labels and
    texts are allowed: a row without an id or label is not learnt from.  Extra columns are
    ignored.  Without labelled documents of both kinds every score is 0.
    """
    model = learnt(labels, docs if corpus is None else corpus, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(rows, model, keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
