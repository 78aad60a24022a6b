"""Sequence generators: fitted probability tables and distributed sampling.

A table is a DataFrame ``(cond, pos, context, token, p)`` or ``(cond, pos, token, p)``; its
size depends on the alphabet, the length, the order and the number of conditions, not on the
rows.  Sampling draws each base by inverting the cumulative probabilities at a uniform
number that is a hash of (seed, row, position), so any row can be drawn anywhere, again,
with the same outcome.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.bases import BASES
from helixframe.operators.profile import position_tokens
from helixframe.shipping import arrow_map


class Generator(Protocol):
    """What fits on labelled sequences and then samples rows for conditions."""

    def fit(self, rows: DataFrame) -> Generator: ...

    def sample(self, requests: DataFrame, seed: int) -> DataFrame: ...


def _bases(spark) -> DataFrame:
    return spark.sql("SELECT explode(array('A', 'C', 'G', 'T')) AS token")


def position_table(rows: DataFrame, length: int, smoothing: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """``(by..., pos, token, p)``: smoothed base probabilities at each position."""
    by, spark = by or [], rows.sparkSession
    counts = position_tokens(rows, 1, keep=by).groupBy(*by, "pos", "token").agg(F.count("*").alias("n"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("rows")).where("rows > 0")
    grid = sizes.crossJoin(F.broadcast(spark.range(length).select(F.col("id").cast("int").alias("pos")))).crossJoin(F.broadcast(_bases(spark)))
    filled = grid.join(counts, [*by, "pos", "token"], "left")
    return filled.select(*by, "pos", "token", ((F.coalesce("n", F.lit(0)) + F.lit(float(smoothing))) / (F.col("rows") + 4 * float(smoothing))).alias("p"))


def context_counts(rows: DataFrame, order: int, length: int, by: list[str]) -> DataFrame:
    """``(by..., pos, context, token, n)``: bases after the ``order`` before them, padded with '^' at the start."""
    padded = F.concat(F.lit("^" * order), F.col("sequence"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.struct(i.alias("pos"), F.substr(padded, i + 1, F.lit(order)).alias("context"), F.substr(F.col("sequence"), i + 1, F.lit(1)).alias("token")))
    return rows.select(*by, F.explode(steps).alias("s")).groupBy(*by, F.col("s.pos").alias("pos"), F.col("s.context").alias("context"), F.col("s.token").alias("token")).agg(F.count("*").alias("n"))


def markov_table(rows: DataFrame, order: int, length: int, smoothing: float = 0.1, by: str = "cond", prior: DataFrame | None = None) -> DataFrame:
    """``(cond, pos, context, token, p)`` for every context seen.

    Without ``prior`` each base gets ``smoothing``; with a table ``(cond, pos, token, p)`` the
    same mass, four times smoothing, is shared in its proportions.
    """
    counts = context_counts(rows, order, length, [by])
    totals = counts.groupBy(by, "pos", "context").agg(F.sum("n").alias("total"))
    grid = totals.crossJoin(F.broadcast(_bases(rows.sparkSession))).join(counts, [by, "pos", "context", "token"], "left")
    if prior is None:
        added = F.lit(float(smoothing))
    else:
        grid = grid.join(prior.withColumnRenamed("p", "prior"), [by, "pos", "token"])
        added = F.lit(4 * float(smoothing)) * F.col("prior")
    return grid.select(F.col(by).alias("cond"), "pos", "context", "token", ((F.coalesce("n", F.lit(0)) + added) / (F.col("total") + 4 * float(smoothing))).alias("p"))


def condition_bins(rows: DataFrame, value: str, bins: int) -> tuple[DataFrame, list[float]]:
    """Adds ``cond``: equal-frequency bins by quantile edges, right-closed; the edges are ``bins - 1`` numbers."""
    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    edges = rows.agg(F.percentile(value, shares).alias("q")).first()["q"]
    number = F.lit(0)
    for e in edges:
        number = number + (F.col(value) > F.lit(float(e))).cast("int")
    return rows.withColumn("cond", number), [float(e) for e in edges]


def bin_centres(binned: DataFrame, value: str) -> DataFrame:
    return binned.groupBy("cond").agg(F.avg(value).alias("centre"), F.count("*").alias("n"))


def centre_weights(requests: DataFrame, centres: DataFrame, value: str) -> DataFrame:
    """Adds ``(low, high, weight)``: the bins whose centres lie around a condition and the weight of the upper; clamped at the ends."""
    w = Window.orderBy("centre")
    spans = centres.select(F.col("cond").alias("low"), F.col("centre").alias("c0"), F.lead("cond").over(w).alias("high"), F.lead("centre").over(w).alias("c1"), F.row_number().over(w).alias("k"))
    x = F.col(value)
    hit = ((x >= F.col("c0")) | (F.col("k") == 1)) & (F.col("c1").isNull() | (x < F.col("c1")))
    met = requests.join(F.broadcast(spans), hit)
    share = F.when(F.col("c1").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("c0")) / (F.col("c1") - F.col("c0")))))
    return met.select(*requests.columns, "low", F.coalesce("high", "low").alias("high"), share.alias("weight"))


def hash_uniform(seed: int, key: Column, pos: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest of (seed, key, position)."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string"), pos.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def sample_positions(requests: DataFrame, table: DataFrame, length: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """Adds ``sequence``: independent draws from a position table; ``requests`` has ``sample_index`` and the ``by`` columns.  No Python runs."""
    by = by or []
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("token", "p"))), lambda x: x["p"])
    lists = table.groupBy(*by, "pos").agg(ordered.alias("p")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]).alias("table"))
    both = requests.join(F.broadcast(lists), by) if by else requests.crossJoin(F.broadcast(lists))
    u = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: hash_uniform(seed, F.col("sample_index"), i))

    def draw(p, x):
        below = lambda k: F.aggregate(F.slice(p, 1, k), F.lit(0.0), lambda s, v: s + v)
        code = sum((x >= below(k)).cast("int") for k in (1, 2, 3))
        return F.substr(F.lit(BASES), code + 1, F.lit(1))

    return both.select(*requests.columns, F.array_join(F.zip_with("table", u, draw), "").alias("sequence"))


class MarkovSampler:
    """Draws sequences base by base from Markov tables; mixes two conditions where asked to.

    The tables go to the executors as arrays; their size is conditions * length * 5 ** order * 4.
    """

    def __init__(self, table: DataFrame, fallback: DataFrame, order: int, length: int):
        self.order, self.length = order, length
        self.table: dict[tuple, np.ndarray] = {}
        for r in table.groupBy("cond", "pos", "context").agg(F.array_sort(F.collect_list(F.struct("token", "p"))).alias("p")).collect():
            self.table[r["cond"], r["pos"], r["context"]] = np.array([x["p"] for x in r["p"]])
        self.fallback = {(r["cond"], r["pos"]): np.array([x["p"] for x in r["p"]]) for r in fallback.groupBy("cond", "pos").agg(F.array_sort(F.collect_list(F.struct("token", "p"))).alias("p")).collect()}

    def _probabilities(self, cond, pos: int, context: str) -> np.ndarray:
        found = self.table.get((cond, pos, context))
        return self.fallback[cond, pos] if found is None else found

    def draw(self, seed: int, key, low, high, weight: float) -> str:
        import hashlib

        text = "^" * self.order
        for pos in range(self.length):
            context = text[len(text) - self.order :]
            p = self._probabilities(low, pos, context)
            if weight and high != low:
                p = (1 - weight) * p + weight * self._probabilities(high, pos, context)
            u = int(hashlib.md5(f"{seed}-{key}-{pos}".encode()).hexdigest()[:13], 16) / 2.0**52
            text += BASES[min(3, int((u >= np.cumsum(p)[:3]).sum()))]
        return text[self.order :]

    def sample(self, requests: DataFrame, seed: int) -> DataFrame:
        """``requests`` has ``sample_index``, ``low``, ``high`` and ``weight``; adds ``sequence``."""
        shared = requests.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("sample_index", "low", "high", "weight")), strict=True)
                drawn = [own.draw(seed, k, a, b, w) for k, a, b, w in rows]
                yield pa.RecordBatch.from_arrays([batch.column("sample_index"), pa.array(drawn, pa.string())], names=["sample_index", "sequence"])

        kind = requests.schema["sample_index"].dataType.simpleString()
        return arrow_map(requests.select("sample_index", "low", "high", F.col("weight").cast("double").alias("weight")), run, f"sample_index {kind}, sequence string")
