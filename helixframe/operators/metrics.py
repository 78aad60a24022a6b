"""Rank metrics, divergences and other statistics.  Doubles are rounded to six decimals at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.bases import hamming
from helixframe.operators.profile import kmer_distribution, position_frequency, position_tokens, token_counts


def _r(c: Column) -> Column:
    """Six decimals, without a negative nought."""
    return F.round(c, 6) + 0.0


# --------------------------------------------------------------------------- ranks and regression


def with_average_rank(df: DataFrame, value: str, name: str, by: list[str] | None = None, ranges: int = 128) -> DataFrame:
    """Adds the zero-based rank of a value, ties getting their average rank.

    Distinct values are counted, the counts summed in order, and the result is joined back, so
    ties cross no window.  The sums run in two levels, over ranges of values and inside
    each, so that no task sees all values of a large group.
    """
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    dealt = _in_ranges(counts, value, by, ranges)
    before = Window.partitionBy(*by).orderBy("_range") if by else Window.orderBy("_range")
    starts = dealt.groupBy(*by, "_range").agg(F.sum("_c").alias("_n"))  # at most `ranges` rows a group
    starts = starts.select(*by, "_range", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = dealt.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(starts if by else F.broadcast(starts), [*by, "_range"])
    ranks = below.select(*by, value, (F.col("_start") + F.col("_in") + (F.col("_c") - 1) / F.lit(2.0)).alias(name))
    return df.join(ranks, [*by, value])


def _in_ranges(counts: DataFrame, value: str, by: list[str], ranges: int) -> DataFrame:
    """Adds ``_range``: distinct values dealt to ranges in their order, about as many to each, by approximate percentiles."""
    shares = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    cuts = counts.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, shares, 20 * ranges)).alias("_cuts"))
    dealt = counts.join(cuts, by) if by else counts.crossJoin(F.broadcast(cuts))
    return dealt.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))).drop("_cuts")


def correlation(a: str, b: str) -> Column:
    """Pearson; null where either side is constant."""
    return F.when((F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def regression_metrics(df: DataFrame, observed: str, predicted: str, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """MAE, RMSE, Pearson and Spearman (null where a side is constant) of each group with ``least`` rows or more."""
    by = by or []
    ranked = with_average_rank(with_average_rank(df.select(*by, F.col(observed).alias("_o"), F.col(predicted).alias("_p")), "_o", "_ro", by), "_p", "_rp", by)
    e = F.col("_p") - F.col("_o")
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), _r(F.avg(F.abs(e))).alias("mae"), _r(F.sqrt(F.avg(e * e))).alias("rmse"), _r(correlation("_o", "_p")).alias("pearson"), _r(correlation("_ro", "_rp")).alias("spearman"))
    return out.where(F.col("n") >= least)


def split_diagnostic(df: DataFrame, observed: str, predicted: str, group: str) -> DataFrame:
    """Regression metrics over all rows and by group, with deviations, their ratio, residual correlation and mean signed error."""
    both = df.withColumn("part", F.explode(F.array(F.lit("all"), F.col(group))))
    base = regression_metrics(both, observed, predicted, ["part"])
    e = F.col(predicted) - F.col(observed)
    more = both.withColumn("_e", e).groupBy("part").agg(
        _r(F.stddev_pop(observed)).alias("observed_sd"),
        _r(F.stddev_pop(predicted)).alias("predicted_sd"),
        _r(F.when(F.stddev_pop(observed) > 0, F.stddev_pop(predicted) / F.stddev_pop(observed))).alias("sd_ratio"),
        _r(correlation("_e", observed)).alias("residual_pearson"),
        _r(F.avg("_e")).alias("mean_error"),
    )
    return base.join(more, "part")


def auroc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counting half; null without both classes."""
    ranked = with_average_rank(df.select(F.col(score).alias("_s"), F.col(positive).cast("int").alias("_y")), "_s", "_r")
    sums = ranked.agg(F.sum(F.when(F.col("_y") == 1, F.col("_r") + 1)).alias("rs"), F.sum("_y").alias("p"), F.sum(1 - F.col("_y")).alias("n"))
    return sums.select(_r(F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("rs") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("n")))).alias("auroc"))


def threshold_counts(df: DataFrame, score: str, positive: str, ranges: int = 128) -> DataFrame:
    """``(score, tp, fp)`` at every distinct score, from the highest down; equal scores are one threshold."""
    counts = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(positive).cast("int")).alias("dp"), F.sum(1 - F.col(positive).cast("int")).alias("dn"))
    dealt = _in_ranges(counts, "score", [], ranges).withColumn("range", -F.col("_range"))  # from the highest down
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("range").agg(F.sum("dp").alias("p"), F.sum("dn").alias("n")).select("range", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    upto = Window.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(starts), "range").select("score", "dp", (F.col("p0") + F.sum("dp").over(upto)).alias("tp"), (F.col("n0") + F.sum("dn").over(upto)).alias("fp"))


def average_precision(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Sum over thresholds of the gain in recall times precision; null without positives."""
    t = threshold_counts(df, score, positive)
    return t.agg(_r(F.when(F.sum("dp") > 0, F.sum(F.col("dp") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("dp"))).alias("average_precision"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman over all rows; null where a rank vector is constant."""
    return regression_metrics(df, a, b).select("n", "spearman")


def confusion(df: DataFrame, score: str, positive: str, threshold: float = 0.5) -> DataFrame:
    """Binary metrics at a threshold; divisions by nought give 0."""
    y, yes = F.col(positive).cast("int") == 1, F.col(score) >= threshold
    c = df.agg(F.count_if(y & yes).alias("tp"), F.count_if(~y & yes).alias("fp"), F.count_if(y & ~yes).alias("fn"), F.count_if(~y & ~yes).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fp)
    return c.select(
        "tp", "fp", "fn", "tn",
        _r(div(tp + tn, tp + fp + fn + tn)).alias("accuracy"),
        _r((recall + specificity) / 2).alias("balanced_accuracy"),
        _r(precision).alias("precision"),
        _r(recall).alias("recall"),
        _r(specificity).alias("specificity"),
        _r(div(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def affine_fit(df: DataFrame, score: str, observed: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares ``observed = intercept + slope * score``; null where the score is constant."""
    slope = F.when(F.var_pop(score) > 0, F.covar_pop(score, observed) / F.var_pop(score))
    return df.groupBy(*(by or [])).agg(_r(slope).alias("slope"), _r(F.avg(observed) - slope * F.avg(score)).alias("intercept"))


def response(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(_r(F.regr_slope(y, x)).alias("slope"), _r(correlation(x, y)).alias("pearson"))


def improvement_share(df: DataFrame, observed: str, new: str, old: str) -> DataFrame:
    better = F.abs(F.col(new) - F.col(observed)) < F.abs(F.col(old) - F.col(observed))
    return df.agg(F.count("*").alias("n"), _r(F.avg(better.cast("double"))).alias("improved"))


def mismatches(df: DataFrame, other: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Rows of either table without partner, and for each column the partners that differ."""
    renamed = other.select(on, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(1).alias("_there"))
    both = df.select(on, *columns, F.lit(1).alias("_here")).join(renamed, on, "full_outer")
    pair = F.col("_here").isNotNull() & F.col("_there").isNotNull()
    return both.agg(
        F.count_if(F.col("_there").isNull()).alias("left_only"),
        F.count_if(F.col("_here").isNull()).alias("right_only"),
        *(F.count_if(pair & ~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"{c}_differs") for c in columns),
    )


# --------------------------------------------------------------------------- distributions


def _js_term(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    return (F.when(p > 0, p * F.ln(p / m)).otherwise(0.0) + F.when(q > 0, q * F.ln(q / m)).otherwise(0.0)) / 2


def js_kmers(a: DataFrame, b: DataFrame, k: int, pseudo: float = 1e-12) -> DataFrame:
    """Jensen-Shannon divergence (natural log) of two k-mer distributions with a pseudo-count."""
    both = kmer_distribution(a, k, pseudo).join(kmer_distribution(b, k, pseudo).withColumnRenamed("p", "q"), "token")
    return both.agg(_r(F.sum(_js_term(F.col("p"), F.col("q")))).alias("js"))


def js_positions(a: DataFrame, b: DataFrame, k: int, length: int) -> DataFrame:
    """``(pos, js)``: divergence of the token frequencies at each position, zero terms skipped."""
    both = position_frequency(a, k, length).join(position_frequency(b, k, length).withColumnRenamed("freq", "q"), ["pos", "token"])
    return both.groupBy("pos").agg(_r(F.sum(_js_term(F.col("freq"), F.col("q")))).alias("js"))


def position_l1(a: DataFrame, b: DataFrame, length: int, k: int = 1) -> DataFrame:
    """Mean over positions of the summed absolute differences of token frequencies."""
    both = position_frequency(a, k, length).join(position_frequency(b, k, length).withColumnRenamed("freq", "q"), ["pos", "token"])
    return both.agg(_r(F.sum(F.abs(F.col("freq") - F.col("q"))) / F.count_distinct("pos")).alias("l1"))


def generation_report(generated: DataFrame, training: DataFrame, length: int, k: int = 3) -> DataFrame:
    """Valid, unique and novel shares, GC of both sides, position L1 and k-mer divergence: one row."""
    from helixframe.functions.bases import gc_fraction, is_valid

    s = F.col("sequence")
    flagged = generated.select("sequence").join(training.select("sequence").distinct().withColumn("known", F.lit(True)), "sequence", "left")
    head = flagged.agg(
        F.count("*").alias("n"),
        _r(F.avg(is_valid(s, length).cast("double"))).alias("valid"),
        _r(F.count_distinct("sequence") / F.count("*")).alias("unique"),
        _r(F.avg(F.col("known").isNull().cast("double"))).alias("novel"),
        _r(F.avg(gc_fraction(s))).alias("gc_mean"),
        _r(F.stddev_pop(gc_fraction(s))).alias("gc_sd"),
    )
    other = training.agg(_r(F.avg(gc_fraction(s))).alias("training_gc_mean"), _r(F.stddev_pop(gc_fraction(s))).alias("training_gc_sd"))
    return head.crossJoin(other).crossJoin(position_l1(generated, training, length)).crossJoin(js_kmers(generated, training, k))


def motif_preservation(generated: DataFrame, reference: DataFrame, k: int = 5, top: int = 20) -> DataFrame:
    """Top k-mers of the reference (count falling, then token): mean absolute error of their shares, and overlap of both top lists over ``top``."""

    def shares(df):
        counts = token_counts(df, k)
        return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("token", "n", (F.col("n") / F.col("total")).alias("share"))

    a, b = shares(reference), shares(generated)
    first = lambda df: df.orderBy(F.col("n").desc(), "token").limit(top)
    error = first(a).select("token", "share").join(b.select("token", F.col("share").alias("other")), "token", "left").agg(_r(F.avg(F.abs(F.col("share") - F.coalesce("other", F.lit(0.0))))).alias("frequency_error"))
    overlap = first(a).select("token").join(first(b).select("token"), "token").agg(_r(F.count("*") / F.lit(float(top))).alias("top_overlap"))
    return error.crossJoin(overlap)


def pairwise_diversity(df: DataFrame, length: int, by: list[str] | None = None) -> DataFrame:
    """Mean Hamming share over all pairs, from base counts a position: mean of (n^2 - sum of c^2) / (n (n - 1))."""
    by = by or []
    counts = position_tokens(df, 1, keep=by).groupBy(*by, "pos", "token").agg(F.count("*").cast("double").alias("c"))
    each = counts.groupBy(*by, "pos").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
    return each.groupBy(*by).agg(_r(F.avg(F.when(F.col("n") > 1, (F.col("n") * F.col("n") - F.col("s")) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0))).alias("diversity"))


def similarity_to_training(scored: DataFrame, length: int) -> DataFrame:
    """Mean and greatest nearest-training similarity, from scores of match counts."""
    return scored.groupBy("q").agg((F.max("score") / float(length)).alias("s")).agg(_r(F.avg("s")).alias("mean_similarity"), _r(F.max("s")).alias("max_similarity"))


def motif_scan(df: DataFrame, motifs: dict[str, tuple[str, tuple[int, ...]]], mismatches_allowed: int = 1, by: list[str] | None = None) -> DataFrame:
    """Share of rows with each motif at any of its starts (from 0) within the mismatches, and with all of them."""
    found = {}
    for name, (motif, starts) in motifs.items():
        tests = [hamming(F.substring("sequence", s + 1, len(motif)), F.lit(motif)) <= mismatches_allowed for s in starts]
        any_of = F.lit(False)
        for t in tests:
            any_of = any_of | F.coalesce(t, F.lit(False))
        found[name] = any_of
    all_of = F.lit(True)
    for c in found.values():
        all_of = all_of & c
    return df.groupBy(*(by or [])).agg(*(_r(F.avg(c.cast("double"))).alias(name) for name, c in found.items()), _r(F.avg(all_of.cast("double"))).alias("all_motifs"))


def bits_per_base(rows: DataFrame, table: DataFrame, fallback: DataFrame, order: int, length: int, by: list[str]) -> DataFrame:
    """Teacher-forced mean -log2 probability per base under ``table(cond, pos, context, token, p)``.

    Contexts the table lacks fall back to ``fallback(cond, pos, token, p)``.  ``rows`` has
    ``sample_index``, ``sequence`` and ``cond``.
    """
    padded = F.concat(F.lit("^" * order), F.col("sequence"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.struct(i.alias("pos"), F.substr(padded, i + 1, F.lit(order)).alias("context"), F.substr(F.col("sequence"), i + 1, F.lit(1)).alias("token")))
    long = rows.select("sample_index", *by, "cond", F.explode(steps).alias("s")).select("sample_index", *by, "cond", "s.pos", "s.context", "s.token")
    known = table.select("cond", "pos", "context").distinct().withColumn("seen", F.lit(True))
    joined = long.join(table, ["cond", "pos", "context", "token"], "left").join(known, ["cond", "pos", "context"], "left").join(fallback.withColumnRenamed("p", "q"), ["cond", "pos", "token"], "left")
    return joined.groupBy(*by).agg(F.count_distinct("sample_index").alias("n"), _r(F.avg(-F.log2(F.when(F.col("seen").isNull(), F.col("q")).otherwise(F.col("p"))))).alias("bits"))
