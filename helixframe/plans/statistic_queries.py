"""Queries over statistics, divergences and metrics (MET)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import generate, joins, metrics, rank
from helixframe.plans.catalog import query
from helixframe.plans.table_queries import kmer_share_sql
from helixframe.sources.fixtures import view

_AVG_RANK = "rank() OVER (ORDER BY {0}) - 1 + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0D"
_AVG_RANK_BY = "rank() OVER (PARTITION BY {1} ORDER BY {0}) - 1 + (count(*) OVER (PARTITION BY {1}, {0}) - 1) / 2.0D"


@query("met01_average_ranks", f"SELECT sample_index, {_AVG_RANK.format('score_b')} AS rank FROM scores")
def met01(spark, d):
    return metrics.with_average_rank(view(spark, d, "scores"), "score_b", "rank").select("sample_index", "rank")


_REG = "count(*) AS n, round(avg(abs({p} - y)), 6) AS mae, round(sqrt(avg(({p} - y) * ({p} - y))), 6) AS rmse, round(corr(y, {p}), 6) + 0 AS pearson, round(corr(ry, rp), 6) + 0 AS spearman"


@query("met02_regression_metrics", f"SELECT {_REG.format(p='score_b')} FROM (SELECT y, score_b, {_AVG_RANK.format('y')} AS ry, {_AVG_RANK.format('score_b')} AS rp FROM scores) t")
def met02(spark, d):
    return metrics.regression_metrics(view(spark, d, "scores"), "y", "score_b")


@query(
    "met03_split_diagnostic",
    f"""SELECT part, {_REG.format(p='score_a')}, round(stddev_pop(y), 6) AS observed_sd, round(stddev_pop(score_a), 6) AS predicted_sd, round(stddev_pop(score_a) / stddev_pop(y), 6) AS sd_ratio, round(corr(score_a - y, y), 6) + 0 AS residual_pearson, round(avg(score_a - y), 6) + 0 AS mean_error
        FROM (SELECT *, {_AVG_RANK_BY.format('y', 'part')} AS ry, {_AVG_RANK_BY.format('score_a', 'part')} AS rp FROM (SELECT 'all' AS part, y, score_a FROM scores UNION ALL SELECT CASE WHEN y <= 2.97 THEN 'weak' WHEN y <= 2.985 THEN 'medium' ELSE 'strong' END, y, score_a FROM scores) a) t GROUP BY 1""",
)
def met03(spark, d):
    from helixframe.functions.bases import group_right_closed

    return metrics.split_diagnostic(view(spark, d, "scores").withColumn("grp", group_right_closed(F.col("y"), 2.97, 2.985)), "y", "score_a", "grp")


@query(
    "met04_grouped_metrics",
    f"SELECT cluster_id, {_REG.format(p='score_a')} FROM (SELECT *, {_AVG_RANK_BY.format('y', 'cluster_id')} AS ry, {_AVG_RANK_BY.format('score_a', 'cluster_id')} AS rp FROM scores WHERE sample_index % 11 <> 0) t GROUP BY 1 HAVING count(*) >= 2",
)
def met04(spark, d):
    return metrics.regression_metrics(view(spark, d, "scores").where("sample_index % 11 <> 0"), "y", "score_a", ["cluster_id"], 2)


@query(
    "met05_auroc",
    f"SELECT round((sum(r + 1) FILTER (p = 1) - sum(p) * (sum(p) + 1) / 2.0D) / nullif(sum(p) * sum(1 - p), 0), 6) AS auroc FROM (SELECT {_AVG_RANK.format('score_b')} AS r, CASE WHEN y >= 2.985 THEN 1 ELSE 0 END AS p FROM scores) t",
)
def met05(spark, d):
    return metrics.auroc(view(spark, d, "scores").withColumn("positive", F.col("y") >= 2.985), "score_b", "positive")


@query(
    "met06_average_precision",
    "SELECT round(sum(dp * tp / cast(tp + fp AS double)) / nullif(sum(dp), 0), 6) AS average_precision FROM (SELECT dp, sum(dp) OVER (ORDER BY s DESC) AS tp, sum(dn) OVER (ORDER BY s DESC) AS fp FROM (SELECT score_b AS s, count(*) FILTER (y >= 2.985) AS dp, count(*) FILTER (y < 2.985) AS dn FROM scores GROUP BY 1) a) t",
)
def met06(spark, d):
    return metrics.average_precision(view(spark, d, "scores").withColumn("positive", F.col("y") >= 2.985), "score_b", "positive")


@query("met07_constant_spearman", "SELECT count(*) AS n, cast(NULL AS double) AS spearman FROM scores")
def met07(spark, d):
    return metrics.spearman(view(spark, d, "scores").withColumn("flat", F.lit(1.0)), "y", "flat")


@query(
    "met08_confusion",
    """SELECT tp, fp, fn, tn, round((tp + tn) / cast(tp + fp + fn + tn AS double), 6) AS accuracy, round((coalesce(tp / nullif(cast(tp + fn AS double), 0), 0) + coalesce(tn / nullif(cast(tn + fp AS double), 0), 0)) / 2, 6) AS balanced_accuracy, round(coalesce(tp / nullif(cast(tp + fp AS double), 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(cast(tp + fn AS double), 0), 0), 6) AS recall, round(coalesce(tn / nullif(cast(tn + fp AS double), 0), 0), 6) AS specificity, round(coalesce(2 * tp / nullif(cast(2 * tp + fp + fn AS double), 0), 0), 6) AS f1 FROM
       (SELECT count(*) FILTER (p AND q) AS tp, count(*) FILTER (NOT p AND q) AS fp, count(*) FILTER (p AND NOT q) AS fn, count(*) FILTER (NOT p AND NOT q) AS tn FROM (SELECT y >= 2.985 AS p, score_b >= 2.9 AS q FROM scores) a) t""",
)
def met08(spark, d):
    return metrics.confusion(view(spark, d, "scores").withColumn("positive", F.col("y") >= 2.985), "score_b", "positive", 2.9)


def _js(p: str, q: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN {p} * ln({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * ln({q} / (({p} + {q}) / 2)) ELSE 0 END) / 2"


@query(
    "met09_js_kmers",
    f"SELECT round(sum({_js('a.p', 'b.p')}), 6) AS js FROM {kmer_share_sql('labelled', 3, chr(115) + 'plit = ' + chr(39) + 'train' + chr(39))} a JOIN {kmer_share_sql('labelled', 3, chr(115) + 'plit = ' + chr(39) + 'test' + chr(39))} b USING (token)",
)
def met09(spark, d):
    rows = view(spark, d, "labelled")
    return metrics.js_kmers(rows.where("split = 'train'"), rows.where("split = 'test'"), 3)


_FREQ = "(SELECT pos, token, sum(CASE WHEN substr(sequence, cast(pos + 1 AS int), 1) = token THEN 1 ELSE 0 END) / count(*) AS f FROM {0}, (SELECT unnest(range(0, 50)) AS pos) p, (SELECT unnest(['A', 'C', 'G', 'T']) AS token) t GROUP BY 1, 2)"
_TRAIN, _TEST = _FREQ.format("(SELECT sequence FROM labelled WHERE split = 'train') x"), _FREQ.format("(SELECT sequence FROM labelled WHERE split = 'test') x")


@query("met10_js_positions", f"SELECT pos, round(sum({_js('a.f', 'b.f')}), 6) AS js FROM {_TRAIN} a JOIN {_TEST} b USING (pos, token) GROUP BY 1")
def met10(spark, d):
    rows = view(spark, d, "labelled")
    return metrics.js_positions(rows.where("split = 'train'"), rows.where("split = 'test'"), 1, 50)


@query("met11_position_l1", f"SELECT round(sum(abs(a.f - b.f)) / 50, 6) AS l1 FROM {_TRAIN} a JOIN {_TEST} b USING (pos, token)")
def met11(spark, d):
    rows = view(spark, d, "labelled")
    return metrics.position_l1(rows.where("split = 'train'"), rows.where("split = 'test'"), 50)


_GC = "(length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', ''))) / 50.0"
_GEN, _ALL = _FREQ.format("generated"), _FREQ.format("sequences")


@query(
    "met12_generation_report",
    f"""SELECT * FROM (SELECT count(*) AS n, 1.0D AS valid, round(count(DISTINCT sequence) / count(*), 6) AS "unique", round(avg(CASE WHEN sequence IN (SELECT sequence FROM sequences) THEN 0 ELSE 1 END), 6) AS novel, round(avg({_GC}), 6) AS gc_mean, round(stddev_pop({_GC}), 6) AS gc_sd FROM generated) a,
        (SELECT round(avg({_GC}), 6) AS training_gc_mean, round(stddev_pop({_GC}), 6) AS training_gc_sd FROM sequences) b, (SELECT round(sum(abs(a.f - b.f)) / 50, 6) AS l1 FROM {_GEN} a JOIN {_ALL} b USING (pos, token)) c,
        (SELECT round(sum({_js('a.p', 'b.p')}), 6) AS js FROM {kmer_share_sql('generated')} a JOIN {kmer_share_sql('sequences')} b USING (token)) e""",
)
def met12(spark, d):
    return metrics.generation_report(view(spark, d, "generated"), view(spark, d, "sequences"), 50)


_K5 = "(SELECT substr(sequence, cast(p AS int), 5) AS token, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM {0}, (SELECT unnest(range(1, 47)) AS p) u GROUP BY 1)"


@query(
    "met13_motif_preservation",
    f"""SELECT round(avg(abs(a.share - coalesce(b.share, 0))), 6) AS frequency_error, round((SELECT count(*) FROM (SELECT token FROM {_K5.format('sequences')} t ORDER BY n DESC, token LIMIT 20) x JOIN (SELECT token FROM {_K5.format('generated')} t ORDER BY n DESC, token LIMIT 20) y USING (token)) / 20.0, 6) AS top_overlap
        FROM (SELECT token, share FROM {_K5.format('sequences')} t ORDER BY n DESC, token LIMIT 20) a LEFT JOIN {_K5.format('generated')} b USING (token)""",
)
def met13(spark, d):
    return metrics.motif_preservation(view(spark, d, "generated"), view(spark, d, "sequences"))


@query(
    "met14_diversity_first_rows",
    """SELECT (SELECT round(avg(hamming(a.sequence, b.sequence) / 50.0), 6) FROM sequences a JOIN sequences b ON a.sample_index < b.sample_index AND b.sample_index < 250) AS diversity, round(avg(s), 6) AS mean_similarity, round(max(s), 6) AS max_similarity
       FROM (SELECT a.sample_index, max(50 - hamming(a.sequence, b.sequence)) / 50.0 AS s FROM labelled a JOIN labelled b ON a.sample_index < 250 AND b.split = 'train' GROUP BY 1) t""",
)
def met14(spark, d):
    rows = view(spark, d, "labelled")
    first = rows.where("sample_index < 250")
    queries = first.select(F.col("sample_index").alias("q"), F.col("sequence").alias("text"))
    references = rows.where("split = 'train'").select(F.col("sample_index").alias("r"), F.col("sequence").alias("text"), F.lit(0.0).alias("label"))
    near = metrics.similarity_to_training(joins.match_counts(queries, references), 50)
    return metrics.pairwise_diversity(first, 50).crossJoin(near)


@query(
    "met15_group_distance",
    f"""SELECT l1, js FROM (SELECT round(sum(abs(a.f - b.f)) / 50, 6) AS l1 FROM {_FREQ.format("(SELECT sequence FROM generated WHERE generator = 'AR') x")} a JOIN {_FREQ.format("(SELECT sequence FROM generated WHERE generator = 'VAE') x")} b USING (pos, token)) x,
        (SELECT round(sum({_js('a.p', 'b.p')}), 6) AS js FROM {kmer_share_sql('generated', 3, "generator = 'AR'")} a JOIN {kmer_share_sql('generated', 3, "generator = 'VAE'")} b USING (token)) y""",
)
def met15(spark, d):
    rows = view(spark, d, "generated")
    a, b = rows.where("generator = 'AR'"), rows.where("generator = 'VAE'")
    return metrics.position_l1(a, b, 50).crossJoin(metrics.js_kmers(a, b, 3))


@query(
    "met16_pairwise_diversity",
    "SELECT split, round(avg((n * n - s) / (n * (n - 1))), 6) AS diversity FROM (SELECT split, pos, sum(c) AS n, sum(c * c) AS s FROM (SELECT split, pos, substr(sequence, cast(pos AS int), 1) AS b, cast(count(*) AS double) AS c FROM labelled, (SELECT unnest(range(1, 51)) AS pos) p GROUP BY 1, 2, 3) t GROUP BY 1, 2) u GROUP BY 1",
)
def met16(spark, d):
    return metrics.pairwise_diversity(view(spark, d, "labelled"), 50, ["split"])


#: Two consensus boxes and where they start, give or take one base.
_MOTIFS = {"box35": ("TTGACA", (14, 15, 16)), "box10": ("TATAAT", (37, 38, 39))}


def _motif_sql(name: str) -> str:
    motif, starts = _MOTIFS[name]
    return "(" + " OR ".join(f"hamming(substr(sequence, {s + 1}, 6), '{motif}') <= 3" for s in starts) + ")"


@query(
    "met17_motif_scan",
    f"SELECT split, round(avg(CASE WHEN {_motif_sql('box35')} THEN 1.0 ELSE 0 END), 6) AS box35, round(avg(CASE WHEN {_motif_sql('box10')} THEN 1.0 ELSE 0 END), 6) AS box10, round(avg(CASE WHEN {_motif_sql('box35')} AND {_motif_sql('box10')} THEN 1.0 ELSE 0 END), 6) AS all_motifs FROM labelled GROUP BY 1",
)
def met17(spark, d):
    return metrics.motif_scan(view(spark, d, "labelled"), _MOTIFS, 3, ["split"])


@query(
    "met18_structure_bundle",
    f"""SELECT gc_mean, l1, js AS js3, frac AS box35 FROM (SELECT round(avg({_GC}), 6) AS gc_mean, round(avg(CASE WHEN {_motif_sql('box35')} THEN 1.0 ELSE 0 END), 6) AS frac FROM generated) a, (SELECT round(sum(abs(a.f - b.f)) / 50, 6) AS l1 FROM {_GEN} a JOIN {_ALL} b USING (pos, token)) b,
        (SELECT round(sum({_js('a.p', 'b.p')}), 6) AS js FROM {kmer_share_sql('generated')} a JOIN {kmer_share_sql('sequences')} b USING (token)) c""",
)
def met18(spark, d):
    from helixframe.functions.bases import gc_fraction

    a, b = view(spark, d, "generated"), view(spark, d, "sequences")
    gc = a.agg(F.round(F.avg(gc_fraction(F.col("sequence"))), 6).alias("gc_mean"))
    return gc.crossJoin(metrics.position_l1(a, b, 50)).crossJoin(metrics.js_kmers(a, b, 3).withColumnRenamed("js", "js3")).crossJoin(metrics.motif_scan(a, _MOTIFS, 3).select("box35"))


@query(
    "met19_bits_per_base",
    f"""WITH steps AS (SELECT split, sample_index, CASE WHEN y < 2.97 THEN 'weak' WHEN y < 2.985 THEN 'medium' ELSE 'strong' END AS cond, pos, substr(concat('^^', sequence), cast(pos + 1 AS int), 2) AS context, substr(sequence, cast(pos + 1 AS int), 1) AS token FROM labelled, (SELECT unnest(range(0, 50)) AS pos) p),
        c AS (SELECT cond, pos, context, token, count(*) AS n FROM steps WHERE split = 'train' GROUP BY ALL), t AS (SELECT cond, pos, context, sum(n) AS total FROM c GROUP BY ALL),
        f AS (SELECT cond, pos, token, count(*) AS n FROM steps WHERE split = 'train' GROUP BY ALL), ft AS (SELECT cond, pos, sum(n) AS total FROM f GROUP BY ALL)
        SELECT split, count(DISTINCT sample_index) AS n, round(avg(-log2(CASE WHEN t.total IS NULL THEN (coalesce(f.n, 0) + 1.0) / (ft.total + 4.0) ELSE (coalesce(c.n, 0) + 0.1) / (t.total + 0.4) END)), 6) AS bits FROM steps s
        LEFT JOIN t USING (cond, pos, context) LEFT JOIN c USING (cond, pos, context, token) LEFT JOIN ft USING (cond, pos) LEFT JOIN f USING (cond, pos, token) GROUP BY 1""",
)
def met19(spark, d):
    from helixframe.functions.bases import group_right_open

    rows = view(spark, d, "labelled").withColumn("cond", group_right_open(F.col("y"), 2.97, 2.985))
    fit = rows.where("split = 'train'")
    table, fallback = generate.markov_table(fit, 2, 50, 0.1), generate.position_table(fit, 50, 1.0, ["cond"])
    return metrics.bits_per_base(rows, table, fallback, 2, 50, ["split"])


@query("met20_response", "SELECT round(regr_slope(score_m, target), 6) AS slope, round(corr(target, score_m), 6) AS pearson FROM generated")
def met20(spark, d):
    return metrics.response(view(spark, d, "generated"), "target", "score_m")


@query("met21_affine_fit", "SELECT fold, round(covar_pop(score_a, y) / var_pop(score_a), 6) AS slope, round(avg(y) - covar_pop(score_a, y) / var_pop(score_a) * avg(score_a), 6) AS intercept FROM scores GROUP BY 1")
def met21(spark, d):
    return metrics.affine_fit(view(spark, d, "scores"), "score_a", "y", ["fold"])


_RANKS = "(SELECT *, row_number() OVER (PARTITION BY generator, grp ORDER BY round(abs(score_m - target), 9), sample_index, run) AS a, row_number() OVER (PARTITION BY generator, grp ORDER BY round(abs(score_s - target), 9), sample_index, run) AS b FROM generated)"


@query("met22_rank_overlap", f"SELECT generator, grp, count(*) FILTER (a <= 50 AND b <= 50) AS overlap, round(corr(a, b), 6) AS spearman FROM {_RANKS} t GROUP BY 1, 2")
def met22(spark, d):
    rows, by = view(spark, d, "generated"), ["generator", "grp"]
    gap = lambda c: F.round(F.abs(F.col(c) - F.col("target")), 9)
    both = rank.rank_by(rank.rank_by(rows, by, [gap("score_m"), F.col("sample_index"), F.col("run")], "a"), by, [gap("score_s"), F.col("sample_index"), F.col("run")], "b")
    return rank.rank_overlap(both, by, "a", "b", 50)


@query("met23_improvement_share", "SELECT count(*) AS n, round(avg(CASE WHEN abs(score_b - y) < abs(score_a - y) THEN 1.0 ELSE 0 END), 6) AS improved FROM scores")
def met23(spark, d):
    return metrics.improvement_share(view(spark, d, "scores"), "y", "score_b", "score_a")


@query("met24_selection_bounds", "SELECT fold, round(avg(g), 6) AS random, round(avg(g) FILTER (k <= 50), 6) AS hindsight FROM (SELECT fold, abs(y - 2.98) AS g, row_number() OVER (PARTITION BY fold ORDER BY abs(y - 2.98), sample_index) AS k FROM scores) t GROUP BY 1")
def met24(spark, d):
    return rank.selection_bounds(view(spark, d, "scores").withColumn("gap", F.abs(F.col("y") - 2.98)), ["fold"], "gap", 50)


@query("met25_mismatches", "SELECT cast(0 AS bigint) AS left_only, count(*) FILTER (sample_index % 10 = 0) AS right_only, cast(0 AS bigint) AS sequence_differs, count(*) FILTER (sample_index % 10 = 1) AS strength_differs FROM sequences")
def met25(spark, d):
    rows = view(spark, d, "sequences")
    left = rows.where("sample_index % 10 <> 0").withColumn("strength", F.when(F.col("sample_index") % 10 == 1, F.col("strength") + 1).otherwise(F.col("strength")))
    return metrics.mismatches(left, rows, "sample_index", ["sequence", "strength"])


