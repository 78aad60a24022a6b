"""Set operations and samples.

Random choices are replaced by the order of a hash of ``(seed, key)``: the same rows come
out whatever the partitioning, and a lost executor changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.bases import gc_count


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")).cast("binary"))


def novelty(df: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Rows whose value is not among the known ones."""
    return df.join(known.select(on).distinct(), on, "left_anti")


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same rows with the same counts, and how many differ on either side."""
    left, right = a.exceptAll(b).agg(F.count("*").alias("left_only")), b.exceptAll(a).agg(F.count("*").alias("right_only"))
    return left.crossJoin(right).select("left_only", "right_only", ((F.col("left_only") == 0) & (F.col("right_only") == 0)).alias("same"))


def split_overlaps(df: DataFrame, key: str, part: str) -> DataFrame:
    """``(a, b, shared)``: values that occur in both of two parts, for every pair that shares any."""
    once = df.select(key, part).distinct()
    return once.join(once.withColumnRenamed(part, "b"), key).where(F.col(part) < F.col("b")).groupBy(F.col(part).alias("a"), "b").agg(F.count("*").alias("shared"))


def subsample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Adds ``chosen``: the n rows that come first in hash order; all others are the complement."""
    first = df.select(F.col(key).alias("_k")).orderBy(hash_order(F.col(key), seed), key).limit(n).withColumn("chosen", F.lit(True))
    return df.join(first, df[key] == F.col("_k"), "left").drop("_k").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def gc_matched(df: DataFrame, by: list[str], arm: str, arms: tuple[str, str], key: str, seed: int = 0) -> DataFrame:
    """Matched rows of two arms: in every stratum of equal GC count both give the lesser of their numbers, first in hash order."""
    rows = df.where(F.col(arm).isin(*arms)).withColumn("gc", gc_count(F.col("sequence")))
    sizes = rows.groupBy(*by, "gc").agg(F.count_if(F.col(arm) == arms[0]).alias("a"), F.count_if(F.col(arm) == arms[1]).alias("b"))
    take = sizes.select(*by, "gc", F.least("a", "b").alias("take")).where("take > 0")
    w = Window.partitionBy(*by, arm, "gc").orderBy(hash_order(F.col(key), seed), key)
    return rows.withColumn("_n", F.row_number().over(w)).join(take, [*by, "gc"]).where("_n <= take").drop("_n", "take")


def shuffle_bases(sequence: Column, key: Column, seed: int) -> Column:
    """The characters of a string in the order of a hash of (seed, key, place): composition stays."""
    places = F.transform(F.sequence(F.lit(1), F.length(sequence)), lambda i: F.struct(F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string"), F.lit("-"), i.cast("string")).cast("binary")).alias("h"), F.substr(sequence, i, F.lit(1)).alias("c")))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["c"]), "")
