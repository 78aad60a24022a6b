"""Profiles and grouped aggregates of sequence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.bases import BASES, gc_fraction, is_valid, kmers


def sequence_profile(df: DataFrame, sequence: str = "sequence", by: list[str] | None = None) -> DataFrame:
    """Rows, distinct, duplicates, invalid strings, lengths and GC of each group.

    Copies are collapsed first, so that a frequent string crosses the shuffle once a task.
    """
    by = by or []
    s = F.col(sequence)
    once = df.groupBy(*by, sequence).agg(F.count("*").alias("c"))
    gc, n = F.when(is_valid(s), gc_fraction(s)), F.when(is_valid(s), F.col("c"))
    total = F.sum(n)
    mean = F.sum(gc * F.col("c")) / total
    return once.groupBy(*by).agg(
        F.sum("c").alias("n_rows"),
        F.count("*").alias("n_unique"),
        (F.sum("c") - F.count("*")).alias("duplicate_rows"),
        F.count_if(F.col("c") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(~is_valid(s), F.col("c"))), F.lit(0)).alias("invalid"),
        F.min(F.length(s)).cast("long").alias("min_length"),
        F.max(F.length(s)).cast("long").alias("max_length"),
        F.round(mean, 6).alias("gc_mean"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum(gc * gc * F.col("c")) / total - mean * mean)), 6).alias("gc_sd"),
        F.round(F.min(gc), 6).alias("gc_min"),
        F.round(F.max(gc), 6).alias("gc_max"),
    )


def numeric_profile(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Missing (null or NaN), exact linear quantiles, extremes and non-positive values."""
    v = F.when(~F.isnan(value), F.col(value))
    out = df.groupBy(*(by or [])).agg(
        F.count_if(v.isNull()).alias("missing"),
        F.min(v).alias("lowest"),
        F.percentile(v, F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75, 0.95)))).alias("q"),
        F.max(v).alias("highest"),
        F.count_if(v <= 0).alias("non_positive"),
    )
    q = {f"q{n}": F.round(F.col("q")[i], 6).alias(f"q{n}") for i, n in enumerate((25, 50, 75, 95))}
    return out.select(*(by or []), "missing", F.round("lowest", 6).alias("lowest"), *q.values(), F.round("highest", 6).alias("highest"), "non_positive")


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins from the least to the greatest value, the last bin closed; empty bins too."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    placed = df.crossJoin(F.broadcast(ends)).select(F.least(F.lit(bins), F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1).cast("int").alias("bin"))
    counted = placed.groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def boundaries(df: DataFrame, value: str, shares: tuple[float, ...] = (1 / 3, 2 / 3)) -> DataFrame:
    """One row of exact linear quantiles, ``b0``, ``b1`` and so on."""
    q = df.agg(F.percentile(value, F.array(*(F.lit(s) for s in shares))).alias("q"))
    return q.select(*(F.col("q")[i].alias(f"b{i}") for i in range(len(shares))))


def group_profile(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("sd"))


def duplicate_summary(df: DataFrame, key: str, **attributes: str) -> DataFrame:
    """Keys of more than one row: how many, their rows, and how many conflict in each attribute."""
    groups = df.groupBy(key).agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(name) for name, c in attributes.items())).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *(F.count_if(F.col(name) > 1).alias(f"{name}_conflicts") for name in attributes))


def collapse_by_median(df: DataFrame, key: str, value: str, label: str) -> DataFrame:
    """One row a key: median value, number of records, and the label that all must share (``consistent``)."""
    return df.groupBy(key).agg(F.round(F.median(value), 6).alias("value"), F.count("*").alias("records"), F.min(label).alias(label), (F.count_distinct(label) == 1).alias("consistent"))


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, 10th percentile, median and 90th percentile."""
    out = df.groupBy(*(by or [])).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return out.select(*(by or []), F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p10", "median", "p90"))))


def group_shares(df: DataFrame, group: str, by: list[str], names: tuple[str, ...] = ("weak", "medium", "strong")) -> DataFrame:
    return df.groupBy(*by).agg(*(F.round(F.avg((F.col(group) == n).cast("double")), 6).alias(f"{n}_share") for n in names))


def roll_up(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Mean and population deviation over runs, with the values in run order."""
    out = df.groupBy(*by).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.array_sort(F.collect_list(F.struct(order, F.round(value, 6).alias("v")))).alias("runs"))
    return out.select(*by, F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), F.array_join(F.transform("runs", lambda r: r["v"].cast("decimal(20,6)").cast("string")), ";").alias("runs"))


def weighted_roll_up(df: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 6).alias("weighted"), F.round(F.avg(value), 6).alias("plain"))


def delimited_set(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(value)), ";").alias(name))


def leave_fold_out_mean(df: DataFrame, value: str, fold: str) -> DataFrame:
    """Each fold with the mean of all other folds, from one aggregate."""
    sums = df.groupBy(fold).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    whole = sums.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    return sums.crossJoin(F.broadcast(whole)).select(fold, F.round((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n")), 6).alias("prediction"))


def paired_differences(df: DataFrame, run: str, arm: str, value: str, new: str, old: str) -> DataFrame:
    """Mean and population deviation of ``new - old`` over the runs that have both arms."""
    wide = df.groupBy(run).agg(F.max(F.when(F.col(arm) == new, F.col(value))).alias("a"), F.max(F.when(F.col(arm) == old, F.col(value))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    d = F.col("a") - F.col("b")
    return wide.agg(F.count("*").alias("runs"), F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_pop(d), 6).alias("sd"))


# --------------------------------------------------------------------------- positions and k-mers


def vocabulary(spark, k: int) -> DataFrame:
    """All k-mers in base order, with their codes; 4 ** k rows."""
    digits = F.transform(F.sequence(F.lit(k - 1), F.lit(0)), lambda i: F.substr(F.lit(BASES), (F.floor(F.col("id") / F.pow(F.lit(4), i)) % 4 + 1).cast("int"), F.lit(1)))
    return spark.range(4**k).select(F.array_join(digits, "").alias("token"), F.col("id").cast("int").alias("code"))


def position_tokens(df: DataFrame, k: int, sequence: str = "sequence", keep: list[str] | None = None) -> DataFrame:
    """``(keep..., pos, token)``: every k-mer with its position from 0."""
    return df.select(*(keep or []), F.posexplode(kmers(F.col(sequence), k)).alias("pos", "token"))


def token_counts(df: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    return position_tokens(df, k, keep=by).groupBy(*(by or []), "token").agg(F.count("*").alias("n"))


def position_frequency(df: DataFrame, k: int, length: int, by: list[str] | None = None) -> DataFrame:
    """Dense ``(by..., pos, token, freq)``: share of rows with a token at a position; zeros for tokens never seen."""
    by = by or []
    counts = position_tokens(df, k, keep=by).groupBy(*by, "pos", "token").agg(F.count("*").alias("n"))
    sizes = df.groupBy(*by).agg(F.count("*").alias("rows")).where("rows > 0")
    spark = df.sparkSession
    grid = sizes.crossJoin(spark.range(length - k + 1).select(F.col("id").cast("int").alias("pos"))).crossJoin(F.broadcast(vocabulary(spark, k).select("token")))
    return grid.join(counts, [*by, "pos", "token"], "left").select(*by, "pos", "token", (F.coalesce("n", F.lit(0)) / F.col("rows")).alias("freq"))


def kmer_distribution(df: DataFrame, k: int, pseudo: float = 1e-12, by: list[str] | None = None) -> DataFrame:
    """Dense ``(by..., token, p)`` over the whole vocabulary with a pseudo-count, normalised."""
    by = by or []
    spark = df.sparkSession
    counts = token_counts(df, k, by)
    grid = F.broadcast(vocabulary(spark, k).select("token"))
    base = df.select(*by).distinct().crossJoin(grid) if by else vocabulary(spark, k).select("token")
    filled = base.join(counts, [*by, "token"], "left").select(*by, "token", (F.coalesce("n", F.lit(0)) + F.lit(pseudo)).alias("x"))
    total = F.sum("x").over(Window.partitionBy(*by)) if by else None
    if by:
        return filled.select(*by, "token", (F.col("x") / total).alias("p"))
    return filled.crossJoin(F.broadcast(filled.agg(F.sum("x").alias("total")))).select("token", (F.col("x") / F.col("total")).alias("p"))


def kmer_features(df: DataFrame, ks: tuple[int, ...] = (1, 2, 3), key: str = "sample_index", sequence: str = "sequence") -> DataFrame:
    """Long-form features ``(key, feature, value)``: k-mer shares of each row and ``gc_share``; zeros are left out."""
    out = None
    for k in ks:
        part = df.select(key, (F.length(sequence) - k + 1).alias("windows"), F.explode(kmers(F.col(sequence), k)).alias("feature"))
        part = part.groupBy(key, "feature", "windows").agg(F.count("*").alias("n")).select(key, "feature", (F.col("n") / F.col("windows")).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.unionByName(df.select(key, F.lit("gc_share").alias("feature"), gc_fraction(F.col(sequence)).alias("value")))


def position_features(df: DataFrame, key: str = "sample_index", sequence: str = "sequence") -> DataFrame:
    """Long-form position one-hot of bases and base pairs, beside the k-mer shares."""
    ones = [position_tokens(df, k, sequence, [key]).select(key, F.concat(F.lit(f"p{k}_"), F.col("pos").cast("string"), F.lit("_"), F.col("token")).alias("feature"), F.lit(1.0).alias("value")) for k in (1, 2)]
    return ones[0].unionByName(ones[1]).unionByName(kmer_features(df, key=key, sequence=sequence))


def explained_variance(df: DataFrame, value: str) -> DataFrame:
    """``(pos, weight)``: 1 + 10 times the share of the label's variance that the base at a position explains."""
    whole = df.agg(F.avg(value).alias("mu"), F.var_pop(value).alias("var"), F.count("*").alias("n"))
    cells = position_tokens(df, 1, keep=[value]).groupBy("pos", "token").agg(F.count("*").alias("k"), F.avg(value).alias("m"))
    gap = F.sum(F.col("k") * (F.col("m") - F.col("mu")) * (F.col("m") - F.col("mu")))
    return cells.crossJoin(F.broadcast(whole)).groupBy("pos").agg(F.when(F.first("var") <= 1e-12, F.lit(1.0)).otherwise(1 + 10 * gap / F.first("n") / F.first("var")).alias("weight"))


def consensus(df: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent base at each position, ties in base order, joined to a string."""
    counts = position_tokens(df, 1, keep=by).groupBy(*by, "pos", "token").agg(F.count("*").alias("n"))
    best = counts.groupBy(*by, "pos").agg(F.min(F.struct((-F.col("n")).alias("m"), "token")).getField("token").alias("token"))
    return best.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("consensus"))


def peaks(df: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Greatest value of each key (null counts as 0) and all positions that attain it, in order."""
    v = df.select(key, position, F.coalesce(F.col(value), F.lit(0)).alias("v"))
    top = v.groupBy(key).agg(F.max("v").alias("peak"))
    return v.join(top, key).where("v = peak").groupBy(key, "peak").agg(F.array_join(F.array_sort(F.collect_list(position)), ";").alias("positions"))


def conditional_counts(df: DataFrame, by: list[str] | None = None, **conditions: Column) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))
