"""Queries over sources, gates, graphs, profiles, sets and samples (SRC, FLT, GRF, AGG, SET, SMP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import bases as B
from helixframe.operators import graph, joins, profile, sampling, validate
from helixframe.plans.catalog import query
from helixframe.sources.fixtures import table, view

_GC = "(length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', '')))"

# --------------------------------------------------------------------------- sources as tables


@query("src01_sequence_table", "SELECT sample_index, upper(sequence) AS sequence, strength FROM sequences WHERE strength > 0 AND length(sequence) = 50")
def src01(spark, d):
    return validate.check_sequences(view(spark, d, "sequences"), 50).select("sample_index", F.upper("sequence").alias("sequence"), "strength")


@query("src02_split_map", "SELECT sample_index, split, cluster_id FROM splits")
def src02(spark, d):
    rows = view(spark, d, "splits").select("sample_index", "split", "cluster_id")
    validate.check_bijection(rows, "sample_index")
    return validate.require(rows, F.col("split").isin("train", "validation", "test"), "unknown split")


@query("src03_cluster_ids", "SELECT s.sample_index, p.cluster_id FROM sequences s JOIN splits p ON s.sample_index = p.sample_index")
def src03(spark, d):
    return view(spark, d, "sequences").select("sample_index").join(view(spark, d, "splits"), "sample_index").select("sample_index", "cluster_id")


@query("src06_category_rows", "SELECT ext_id, tss_name, strand FROM external WHERE category = 'tss'")
def src06(spark, d):
    return view(spark, d, "external").where("category = 'tss'").select("ext_id", "tss_name", "strand")


# --------------------------------------------------------------------------- gates


@query("flt01_valid", "SELECT sample_index FROM sequences WHERE length(sequence) = 50 AND regexp_matches(sequence, '^[ACGT]+$')")
def flt01(spark, d):
    return view(spark, d, "sequences").where(B.is_valid(F.col("sequence"), 50)).select("sample_index")


@query("flt02_gap_threshold", "SELECT ext_id FROM external WHERE tss_position > 200")
def flt02(spark, d):
    return view(spark, d, "external").where("tss_position > 200").select("ext_id")


@query(
    "flt03_eligible",
    f"SELECT sample_index FROM sequences WHERE {_GC} BETWEEN 20 AND 30 AND NOT regexp_matches(sequence, 'A{{4}}|C{{4}}|G{{4}}|T{{4}}')",
)
def flt03(spark, d):
    s = F.col("sequence")
    return view(spark, d, "sequences").where(B.gc_count(s).between(20, 30) & (B.longest_run(s) <= 3)).select("sample_index")


@query("flt04_quality_flag", "SELECT lib_id FROM library WHERE quality = 'Yes'")
def flt04(spark, d):
    return view(spark, d, "library").where("quality = 'Yes'").select("lib_id")


@query("flt05_novel", "SELECT sample_index FROM sequences WHERE sequence NOT IN (SELECT sequence FROM labelled WHERE split = 'train')")
def flt05(spark, d):
    rows = view(spark, d, "labelled")
    return sampling.novelty(rows, rows.where("split = 'train'"), "sequence").select("sample_index")


@query("flt08_leakage", "SELECT cluster_id, count(DISTINCT split) AS parts FROM splits GROUP BY 1 HAVING count(DISTINCT split) > 1")
def flt08(spark, d):
    return validate.spanning_groups(view(spark, d, "splits"), "cluster_id", "split")


@query("flt08_leakage_planted", "SELECT fam AS cluster_id, count(DISTINCT split) AS parts FROM (SELECT cluster_id - cluster_id % 2 AS fam, split FROM splits) t GROUP BY 1 HAVING count(DISTINCT split) > 1")
def flt08_planted(spark, d):
    merged = view(spark, d, "splits").withColumn("cluster_id", F.col("cluster_id") - F.col("cluster_id") % 2)
    return validate.spanning_groups(merged, "cluster_id", "split")


@query(
    "flt09_dense_index",
    "SELECT split, count(*) AS n, count(DISTINCT sample_index) AS n_distinct, min(sample_index) AS lowest, max(sample_index) AS highest, count(*) = count(DISTINCT sample_index) AND min(sample_index) = 0 AND max(sample_index) = count(*) - 1 AS dense FROM (SELECT 'all' AS split, sample_index FROM splits UNION ALL SELECT split, sample_index FROM splits) t GROUP BY 1",
)
def flt09(spark, d):
    rows = view(spark, d, "splits").select(F.explode(F.array(F.lit("all"), "split")).alias("split"), "sample_index")
    return validate.bijection(rows, "sample_index", ["split"])


@query("flt10_conflicting_labels", "SELECT m2, count(DISTINCT quality) AS labels, count(*) AS n FROM library GROUP BY 1 HAVING count(DISTINCT quality) > 1")
def flt10(spark, d):
    return validate.conflicting_labels(view(spark, d, "library"), "m2", "quality")


@query("flt06_provenance_gate", "SELECT sha256(string_agg(text, chr(10) ORDER BY item_id)) AS digest, true AS holds FROM benchmark")
def flt06(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"])
    row = table(spark, d, "benchmark").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest")).first()
    validate.check_digest(row["digest"], row["digest"], "benchmark")
    return spark.createDataFrame([(row["digest"], True)], "digest string, holds boolean")


@query("flt07_reproduced_metric", "SELECT round(avg(abs(score_a - y)), 6) AS mae, true AS holds FROM scores")
def flt07(spark, d):
    rows = view(spark, d, "scores")
    new = rows.agg(F.avg(F.abs(F.col("score_a") - F.col("y"))).alias("m")).first()["m"]
    again = rows.groupBy("fold").agg(F.sum(F.abs(F.col("score_a") - F.col("y"))).alias("s"), F.count("*").alias("n")).agg(F.sum("s") / F.sum("n")).first()[0]
    validate.check_reproduced(new, again, 1e-9, "mean absolute error")
    return rows.agg(F.round(F.avg(F.abs(F.col("score_a") - F.col("y"))), 6).alias("mae"), F.lit(True).alias("holds"))


@query("flt11_conclusion", "SELECT round(avg(abs(score_b - y)), 6) AS b, round(avg(abs(score_a - y)), 6) AS a, avg(abs(score_b - y)) < avg(abs(score_a - y)) AS holds FROM scores")
def flt11(spark, d):
    out = view(spark, d, "scores").agg(F.avg(F.abs(F.col("score_b") - F.col("y"))).alias("b"), F.avg(F.abs(F.col("score_a") - F.col("y"))).alias("a"))
    return out.select(F.round("b", 6).alias("b"), F.round("a", 6).alias("a"), (F.col("b") < F.col("a")).alias("holds"))


# --------------------------------------------------------------------------- graph

_COMPONENTS_SQL = """
WITH RECURSIVE edges AS (SELECT a.sample_index AS i, b.sample_index AS j FROM sequences a JOIN sequences b ON a.sample_index < b.sample_index AND hamming(a.sequence, b.sequence) <= 5),
both_ways AS (SELECT i, j FROM edges UNION ALL SELECT j, i FROM edges),
reach(id, other) AS (SELECT sample_index, sample_index FROM sequences UNION SELECT r.id, b.j FROM reach r JOIN both_ways b ON r.other = b.i),
roots AS (SELECT id, min(other) AS root FROM reach GROUP BY 1)
"""


def _components(spark, d):
    rows = view(spark, d, "sequences")
    edges = joins.hamming_self_join(rows, 5, 50).select("i", "j")
    return graph.connected_components(rows.select(F.col("sample_index").alias("id")), edges), edges


@query("grf01_components", _COMPONENTS_SQL + "SELECT id, root FROM roots")
def grf01(spark, d):
    return _components(spark, d)[0]


@query("grf02_canonical_labels", _COMPONENTS_SQL + "SELECT id, root, dense_rank() OVER (ORDER BY root) - 1 AS label FROM roots")
def grf02(spark, d):
    return graph.canonical_labels(_components(spark, d)[0])


@query(
    "grf03_cluster_summary",
    _COMPONENTS_SQL
    + """SELECT cast(sum(n) AS bigint) AS nodes, count(*) AS clusters, max(n) AS largest, count(*) FILTER (n = 1) AS singletons, cast(sum(n) - count(*) AS bigint) AS forest_edges, (SELECT count(*) FROM edges) AS pair_edges
         FROM (SELECT root, count(*) AS n FROM roots GROUP BY 1) t""",
)
def grf03(spark, d):
    found, edges = _components(spark, d)
    return graph.cluster_summary(found, edges)


def _cluster_sizes(spark, d):
    sizes = view(spark, d, "splits").groupBy("cluster_id").agg(F.count("*").alias("n"))
    return [(r["cluster_id"], r["n"]) for r in sizes.orderBy("cluster_id").collect()]  # the assignment is sequential over the table of cluster sizes


def greedy_split_sql(clusters: str) -> str:
    """The greedy assignment of ``clusters(cluster_id, n)`` to three splits, one cluster a step."""
    cost = lambda extra: " + ".join(f"pow((f{i} + {'n' if i == extra else '0'} - {share} * t) / ({share} * t), 2)" for i, share in enumerate(("0.7D", "0.15D", "0.15D")))
    best = "list_sort([" + ", ".join(f"[round({cost(i)}, 12), f{i}, {i}]" for i in range(3)) + "])[1][3]"
    return f"""ordered AS (SELECT cluster_id, cast(n AS double) AS n, row_number() OVER (ORDER BY n DESC, cluster_id) AS k, cast(sum(n) OVER () AS double) AS t FROM {clusters}),
  walk AS (SELECT cast(0 AS bigint) AS k, 0.0D AS f0, 0.0D AS f1, 0.0D AS f2, cast(NULL AS bigint) AS cluster_id, 0.0D AS part
    UNION ALL SELECT k, f0 + CASE WHEN part = 0 THEN n ELSE 0 END, f1 + CASE WHEN part = 1 THEN n ELSE 0 END, f2 + CASE WHEN part = 2 THEN n ELSE 0 END, cluster_id, part
      FROM (SELECT o.k, o.n, o.cluster_id, f0, f1, f2, {best} AS part FROM walk w JOIN ordered o ON o.k = w.k + 1) s),
  dealt AS (SELECT cluster_id, CASE part WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM walk WHERE k > 0)"""


@query("grf04_greedy_split", f"WITH RECURSIVE {greedy_split_sql('(SELECT cluster_id, count(*) AS n FROM splits GROUP BY 1)')} SELECT cluster_id, split FROM dealt")
def grf04(spark, d):
    found = graph.greedy_split(_cluster_sizes(spark, d), {"train": 0.7, "validation": 0.15, "test": 0.15})
    return spark.createDataFrame(sorted(found.items()), "cluster_id long, split string")


@query("grf05_greedy_folds")
def grf05(spark, d):
    return spark.createDataFrame(sorted(graph.greedy_folds(_cluster_sizes(spark, d), 3, 25).items()), "cluster_id long, fold int")


@query("grf06_nested_folds")
def grf06(spark, d):
    layout = graph.nested_folds(_cluster_sizes(spark, d), 3, 5, 25)
    return spark.createDataFrame([(k, c, f) for k, part in enumerate(layout) for c, f in sorted(part["inner"].items())], "outer_fold int, cluster_id long, inner_fold int")


_SPLIT_HASH = "md5(concat(cast(sample_index AS STR), '-25'))"


@query(
    "grf07_hashed_split",
    f"""SELECT sample_index, CASE WHEN k < floor(n * 0.7D) THEN 'train' WHEN k < floor(n * 0.7D) + floor(n * 0.15D) THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT sample_index, row_number() OVER (ORDER BY {_SPLIT_HASH}, sample_index) - 1 AS k, count(*) OVER () AS n FROM sequences) t""",
)
def grf07(spark, d):
    return graph.hashed_split(view(spark, d, "sequences"), "sample_index", (0.7, 0.15), 25)


@query("grf08_stratified_group_folds")
def grf08(spark, d):
    counts = view(spark, d, "labelled").groupBy("cluster_id").agg(F.count_if(F.col("strength") >= 970).alias("p"), F.count_if(F.col("strength") < 970).alias("n"))
    rows = [(r["cluster_id"], r["p"], r["n"]) for r in counts.orderBy("cluster_id").collect()]
    return spark.createDataFrame(sorted(graph.stratified_group_folds(rows, 5, 25).items()), "cluster_id long, fold int")


@query("grf08_stratified_holdout")
def grf08_holdout(spark, d):
    """A test hold-out of five folds, and a validation part of four over the rest."""
    counts = view(spark, d, "labelled").groupBy("cluster_id").agg(F.count_if(F.col("strength") >= 970).alias("p"), F.count_if(F.col("strength") < 970).alias("n"))
    rows = [(r["cluster_id"], r["p"], r["n"]) for r in counts.orderBy("cluster_id").collect()]
    return spark.createDataFrame(sorted(graph.holdout_and_folds(rows, 5, 4, 25).items()), "cluster_id long, part string")


# --------------------------------------------------------------------------- profiles


@query(
    "agg01_sequence_profile",
    f"""SELECT grp, cast(sum(c) AS bigint) AS n_rows, count(*) AS n_unique, cast(sum(c) - count(*) AS bigint) AS duplicate_rows, count(*) FILTER (c > 1) AS duplicate_groups, cast(0 AS bigint) AS invalid, min(length(s)) AS min_length, max(length(s)) AS max_length,
        round(sum(gc * c) / sum(c), 6) AS gc_mean, round(sqrt(greatest(0, sum(gc * gc * c) / sum(c) - (sum(gc * c) / sum(c)) * (sum(gc * c) / sum(c)))), 6) AS gc_sd, round(min(gc), 6) AS gc_min, round(max(gc), 6) AS gc_max
        FROM (SELECT grp, s, count(*) AS c, (length(s) - length(replace(replace(s, 'G', ''), 'C', ''))) / length(s) AS gc FROM (SELECT grp, substr(sequence, 1, 8) AS s FROM generated) a GROUP BY 1, 2) b GROUP BY 1""",
)
def agg01(spark, d):
    return profile.sequence_profile(view(spark, d, "generated").select("grp", F.substring("sequence", 1, 8).alias("sequence")), by=["grp"])


@query(
    "agg02_numeric_profile",
    """SELECT c_mktsegment AS seg, count(*) FILTER (v IS NULL) AS missing, round(min(v), 6) AS lowest, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75,
       round(quantile_cont(v, 0.95), 6) AS q95, round(max(v), 6) AS highest, count(*) FILTER (v <= 0) AS non_positive FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS v FROM customer) t GROUP BY 1""",
)
def agg02(spark, d):
    v = F.when(F.col("c_custkey") % 26 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal"))
    return profile.numeric_profile(table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), v.alias("v")), "v", ["seg"])


@query(
    "agg03_histogram",
    """SELECT bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 31)) AS bin) b LEFT JOIN
       (SELECT least(30, cast(floor((strength - lo) / ((hi - lo) / 30)) AS int) + 1) AS bin, count(*) AS n FROM sequences, (SELECT min(strength) AS lo, max(strength) AS hi FROM sequences) e GROUP BY 1) c USING (bin)""",
)
def agg03(spark, d):
    return profile.histogram(view(spark, d, "sequences"), "strength")


@query("agg04_tertiles", "SELECT round(quantile_cont(y, 1/3.0), 6) AS b0, round(quantile_cont(y, 2/3.0), 6) AS b1 FROM labelled WHERE split = 'train'")
def agg04(spark, d):
    b = profile.boundaries(view(spark, d, "labelled").where("split = 'train'"), "y")
    return b.select(F.round("b0", 6).alias("b0"), F.round("b1", 6).alias("b1"))


@query(
    "agg05_group_profile",
    f"""SELECT split, grp, count(*) AS n, round(avg({_GC} / 50.0), 6) AS mean, round(stddev_pop({_GC} / 50.0), 6) AS sd
        FROM (SELECT split, sequence, CASE WHEN y < b0 THEN 'weak' WHEN y < b1 THEN 'medium' ELSE 'strong' END AS grp FROM labelled,
          (SELECT quantile_cont(y, 1/3.0) AS b0, quantile_cont(y, 2/3.0) AS b1 FROM labelled WHERE split = 'train') e) t GROUP BY 1, 2""",
)
def agg05(spark, d):
    rows = view(spark, d, "labelled")
    edges = profile.boundaries(rows.where("split = 'train'"), "y")
    named = rows.crossJoin(F.broadcast(edges)).select("split", B.group_right_open(F.col("y"), F.col("b0"), F.col("b1")).alias("grp"), B.gc_fraction(F.col("sequence")).alias("gc"))
    return profile.group_profile(named, "gc", ["split", "grp"])


@query(
    "agg06_duplicate_conflicts",
    "SELECT count(*) AS groups, cast(sum(n) AS bigint) AS rows, count(*) FILTER (a > 1) AS quality_conflicts, count(*) FILTER (b > 1) AS context_conflicts FROM (SELECT m2, count(*) AS n, count(DISTINCT quality) AS a, count(DISTINCT m3) AS b FROM library GROUP BY 1 HAVING count(*) > 1) t",
)
def agg06(spark, d):
    return profile.duplicate_summary(view(spark, d, "library"), "m2", quality="quality", context="m3")


@query(
    "agg07_collapse_median",
    "SELECT m2, round(median(amount), 6) AS value, count(*) AS records, min(quality) AS quality, count(DISTINCT quality) = 1 AS consistent FROM library GROUP BY 1",
)
def agg07(spark, d):
    return profile.collapse_by_median(view(spark, d, "library"), "m2", "amount", "quality")


@query("agg08_size_nunique", "SELECT m3, count(*) AS size, count(DISTINCT m2) AS nunique FROM library GROUP BY 1")
def agg08(spark, d):
    return view(spark, d, "library").groupBy("m3").agg(F.count("*").alias("size"), F.count_distinct("m2").alias("nunique"))


@query(
    "agg09_kmer_features",
    f"""SELECT sample_index, token AS feature, round(count(*) / cast(51 - k AS double), 6) AS value FROM (SELECT sample_index, k, substr(sequence, cast(p AS int), cast(k AS int)) AS token FROM sequences, (SELECT k, unnest(range(1, 52 - k)) AS p FROM (SELECT unnest([1, 2, 3]) AS k) a) b) c GROUP BY 1, 2, k
        UNION ALL SELECT sample_index, 'gc_share', round({_GC} / 50.0, 6) FROM sequences""",
)
def agg09(spark, d):
    return profile.kmer_features(view(spark, d, "sequences")).select("sample_index", "feature", F.round("value", 6).alias("value"))


@query(
    "agg10_position_features",
    """SELECT substr(feature, 1, 2) AS kind, count(*) AS cells, count(DISTINCT feature) AS features FROM (SELECT concat('p1_', cast(p - 1 AS STR), '_', substr(sequence, cast(p AS int), 1)) AS feature FROM sequences, (SELECT unnest(range(1, 51)) AS p) a
       UNION ALL SELECT concat('p2_', cast(p - 1 AS STR), '_', substr(sequence, cast(p AS int), 2)) FROM sequences, (SELECT unnest(range(1, 50)) AS p) b) t GROUP BY 1""",
)
def agg10(spark, d):
    long = profile.position_features(view(spark, d, "sequences")).where("feature RLIKE '^p[12]_'")
    return long.groupBy(F.substring("feature", 1, 2).alias("kind")).agg(F.count("*").alias("cells"), F.count_distinct("feature").alias("features"))


@query(
    "agg11_position_base_frequency",
    "SELECT pos, token, round(sum(CASE WHEN substr(sequence, cast(pos + 1 AS int), 1) = token THEN 1 ELSE 0 END) / count(*), 6) AS freq FROM sequences, (SELECT unnest(range(0, 50)) AS pos) p, (SELECT unnest(['A', 'C', 'G', 'T']) AS token) t GROUP BY 1, 2",
)
def agg11(spark, d):
    return profile.position_frequency(view(spark, d, "sequences"), 1, 50).select("pos", "token", F.round("freq", 6).alias("freq"))


_GRID2 = "(SELECT a || b AS token FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS a) x, (SELECT unnest(['A', 'C', 'G', 'T']) AS b) y)"


@query(
    "agg12_position_kmer_frequency",
    f"""SELECT split, pos, token, round(coalesce(n, 0) / rows, 6) AS freq FROM (SELECT split, count(*) AS rows FROM labelled GROUP BY 1) s CROSS JOIN (SELECT unnest(range(0, 49)) AS pos) p CROSS JOIN {_GRID2} g
        LEFT JOIN (SELECT split, pos, substr(sequence, cast(pos + 1 AS int), 2) AS token, count(*) AS n FROM labelled, (SELECT unnest(range(0, 49)) AS pos) q GROUP BY 1, 2, 3) c USING (split, pos, token)""",
)
def agg12(spark, d):
    return profile.position_frequency(view(spark, d, "labelled"), 2, 50, ["split"]).select("split", "pos", "token", F.round("freq", 6).alias("freq"))


_GRID3 = "(SELECT a || b || c AS token FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS a) x, (SELECT unnest(['A', 'C', 'G', 'T']) AS b) y, (SELECT unnest(['A', 'C', 'G', 'T']) AS c) z)"


def kmer_share_sql(source: str, k: int = 3, where: str = "true") -> str:
    """SQL of the smoothed 3-mer distribution of a view: (token, p)."""
    return f"""(SELECT token, (coalesce(n, 0) + 1e-12) / sum(coalesce(n, 0) + 1e-12) OVER () AS p FROM {_GRID3} g LEFT JOIN
        (SELECT substr(sequence, cast(q AS int), {k}) AS token, count(*) AS n FROM {source}, (SELECT unnest(range(1, {52 - k})) AS q) u WHERE {where} GROUP BY 1) c USING (token))"""


@query("agg13_kmer_distribution", f"SELECT token, round(p, 9) AS p FROM {kmer_share_sql('sequences')} t")
def agg13(spark, d):
    return profile.kmer_distribution(view(spark, d, "sequences"), 3).select("token", F.round("p", 9).alias("p"))


@query(
    "agg14_conditional_counts",
    "SELECT category, count(*) FILTER (strand = '+') AS plus, count(*) FILTER (activity = 'active') AS active, count(*) FILTER (activity = 'active' AND expression > 5) AS high_active, count(*) FILTER (expression < 0) AS negative FROM external GROUP BY 1",
)
def agg14(spark, d):
    c = F.col
    return profile.conditional_counts(view(spark, d, "external"), ["category"], plus=c("strand") == "+", active=c("activity") == "active", high_active=(c("activity") == "active") & (c("expression") > 5), negative=c("expression") < 0)


@query("agg15_category_counts", "SELECT category, strand, activity, count(*) AS n FROM external GROUP BY 1, 2, 3")
def agg15(spark, d):
    return view(spark, d, "external").groupBy("category", "strand", "activity").agg(F.count("*").alias("n"))


@query(
    "agg16_explained_variance",
    """SELECT pos, round(CASE WHEN var <= 1e-12 THEN 1.0 ELSE 1 + 10 * sum(k * (m - mu) * (m - mu)) / n / var END, 6) AS weight FROM
       (SELECT pos, substr(sequence, cast(pos + 1 AS int), 1) AS c, count(*) AS k, avg(y) AS m FROM labelled, (SELECT unnest(range(0, 50)) AS pos) p GROUP BY 1, 2) t, (SELECT avg(y) AS mu, var_pop(y) AS var, count(*) AS n FROM labelled) w GROUP BY pos, var, n""",
)
def agg16(spark, d):
    return profile.explained_variance(view(spark, d, "labelled"), "y").select("pos", F.round("weight", 6).alias("weight"))


@query(
    "agg17_describe",
    "SELECT generator, grp, round(avg(score_m), 6) AS mean, round(stddev_pop(score_m), 6) AS sd, round(quantile_cont(score_m, 0.1), 6) AS p10, round(quantile_cont(score_m, 0.5), 6) AS median, round(quantile_cont(score_m, 0.9), 6) AS p90 FROM generated GROUP BY 1, 2",
)
def agg17(spark, d):
    return profile.describe(view(spark, d, "generated"), "score_m", ["generator", "grp"])


@query(
    "agg18_group_shares",
    "SELECT grp, round(avg(CASE WHEN score_m < 2.0 THEN 1.0 ELSE 0.0 END), 6) AS weak_share, round(avg(CASE WHEN score_m >= 2.0 AND score_m < 2.5 THEN 1.0 ELSE 0.0 END), 6) AS medium_share, round(avg(CASE WHEN score_m >= 2.5 THEN 1.0 ELSE 0.0 END), 6) AS strong_share FROM generated GROUP BY 1",
)
def agg18(spark, d):
    rows = view(spark, d, "generated").withColumn("named", B.group_right_open(F.col("score_m"), 2.0, 2.5))
    return profile.group_shares(rows, "named", ["grp"])


_RUNS = "(SELECT generator, grp, run, avg(score_m) AS v, count(*) AS n FROM generated GROUP BY 1, 2, 3)"


@query("agg19_seed_roll_up", f"SELECT generator, grp, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, string_agg(cast(cast(round(v, 6) AS decimal(20, 6)) AS STR), ';' ORDER BY run) AS runs FROM {_RUNS} t GROUP BY 1, 2")
def agg19(spark, d):
    runs = view(spark, d, "generated").groupBy("generator", "grp", "run").agg(F.avg("score_m").alias("v"))
    return profile.roll_up(runs, "v", ["generator", "grp"], "run")


@query("agg20_weighted_roll_up", f"SELECT generator, round(sum(v * n) / sum(n), 6) AS weighted, round(avg(v), 6) AS plain FROM {_RUNS} t GROUP BY 1")
def agg20(spark, d):
    runs = view(spark, d, "generated").groupBy("generator", "grp", "run").agg(F.avg("score_m").alias("v"), F.count("*").alias("n"))
    return profile.weighted_roll_up(runs, "v", "n", ["generator"])


@query(
    "agg21_profile_mean",
    """SELECT generator, pos, token, round(avg(f), 6) AS freq FROM (SELECT generator, run, pos, token, sum(CASE WHEN substr(sequence, cast(pos + 1 AS int), 1) = token THEN 1 ELSE 0 END) / count(*) AS f
       FROM generated, (SELECT unnest(range(0, 50)) AS pos) p, (SELECT unnest(['A', 'C', 'G', 'T']) AS token) t GROUP BY 1, 2, 3, 4) u GROUP BY 1, 2, 3""",
)
def agg21(spark, d):
    f = profile.position_frequency(view(spark, d, "generated"), 1, 50, ["generator", "run"])
    return f.groupBy("generator", "pos", "token").agg(F.round(F.avg("freq"), 6).alias("freq"))


@query("agg22_delimited_set", "SELECT m3, string_agg(DISTINCT m2, ';' ORDER BY m2) AS modules FROM library GROUP BY 1")
def agg22(spark, d):
    return profile.delimited_set(view(spark, d, "library"), "m2", ["m3"], "modules")


@query(
    "agg23_consensus",
    """SELECT split, string_agg(token, '' ORDER BY pos) AS consensus FROM (SELECT split, pos, substr(sequence, cast(pos + 1 AS int), 1) AS token, row_number() OVER (PARTITION BY split, pos ORDER BY count(*) DESC, substr(sequence, cast(pos + 1 AS int), 1)) AS k
       FROM labelled, (SELECT unnest(range(0, 50)) AS pos) p GROUP BY split, pos, substr(sequence, cast(pos + 1 AS int), 1)) t WHERE k = 1 GROUP BY 1""",
)
def agg23(spark, d):
    return profile.consensus(view(spark, d, "labelled"), ["split"])


@query(
    "agg24_peaks",
    "SELECT lib_id, peak, string_agg(cast(pos AS STR), ';' ORDER BY pos) AS positions FROM (SELECT lib_id, pos, coalesce(hits, 0) AS v, max(coalesce(hits, 0)) OVER (PARTITION BY lib_id) AS peak FROM tss_counts) t WHERE v = peak GROUP BY 1, 2",
)
def agg24(spark, d):
    return profile.peaks(view(spark, d, "tss_counts"), "lib_id", "pos", "hits")


@query("agg25_leave_fold_out", "SELECT fold, round((t - s) / (m - n), 6) AS prediction FROM (SELECT fold, sum(y) AS s, count(*) AS n FROM scores GROUP BY 1) a, (SELECT sum(y) AS t, count(*) AS m FROM scores) b")
def agg25(spark, d):
    return profile.leave_fold_out_mean(view(spark, d, "scores"), "y", "fold")


@query(
    "agg26_paired_differences",
    "SELECT count(*) AS runs, round(avg(a - b), 6) AS mean, round(stddev_pop(a - b), 6) AS sd FROM (SELECT run, avg(score_m) FILTER (generator = 'AR') AS a, avg(score_m) FILTER (generator = 'VAE') AS b FROM generated GROUP BY 1) t WHERE a IS NOT NULL AND b IS NOT NULL",
)
def agg26(spark, d):
    runs = view(spark, d, "generated").groupBy("generator", "run").agg(F.avg("score_m").alias("v"))
    return profile.paired_differences(runs, "run", "generator", "v", "AR", "VAE")


# --------------------------------------------------------------------------- sets and samples


@query("set01_union", "SELECT sample_index, 'train' AS origin FROM labelled WHERE split = 'train' UNION ALL SELECT sample_index, 'rest' FROM labelled WHERE split <> 'train'")
def set01(spark, d):
    rows = view(spark, d, "labelled")
    return rows.where("split = 'train'").select("sample_index", F.lit("train").alias("origin")).unionByName(rows.where("split <> 'train'").select("sample_index", F.lit("rest").alias("origin")))


@query("set02_intersect", "SELECT m2 AS part FROM library WHERE quality = 'Yes' INTERSECT SELECT m2 FROM library WHERE quality = 'No'")
def set02(spark, d):
    rows = view(spark, d, "library").select(F.col("m2").alias("part"), "quality")
    return rows.where("quality = 'Yes'").select("part").intersect(rows.where("quality = 'No'").select("part"))


@query("set03_except", "SELECT m3 AS part FROM library WHERE quality = 'Yes' EXCEPT SELECT m3 FROM library WHERE lib_id % 20 < 7")
def set03(spark, d):
    rows = view(spark, d, "library").select(F.col("m3").alias("part"), "quality", "lib_id")
    return rows.where("quality = 'Yes'").select("part").subtract(rows.where("lib_id % 20 < 7").select("part"))


@query("set04_distinct_count", "SELECT count(DISTINCT sequence) AS n FROM generated")
def set04(spark, d):
    return view(spark, d, "generated").agg(F.count_distinct("sequence").alias("n"))


@query("set05_same_set", "SELECT cast(0 AS bigint) AS left_only, count(*) AS right_only, count(*) = 0 AS same FROM labelled WHERE split = 'test'")
def set05(spark, d):
    rows = view(spark, d, "labelled").select("sample_index", "sequence", "split")
    return sampling.same_set(rows.where("split <> 'test'"), rows)


@query("smp01_gc_matched_counts", f"""SELECT generator, run, gc, least(a, b) AS n FROM (SELECT generator, run, {_GC} AS gc, count(*) FILTER (grp = 'weak') AS a, count(*) FILTER (grp = 'strong') AS b FROM generated GROUP BY 1, 2, 3) t WHERE least(a, b) > 0""")
def smp01(spark, d):
    matched = sampling.gc_matched(view(spark, d, "generated"), ["generator", "run"], "grp", ("weak", "strong"), "sample_index")
    return matched.where("grp = 'weak'").groupBy("generator", "run", "gc").agg(F.count("*").alias("n"))


@query("smp02_subsample", "SELECT sample_index, row_number() OVER (ORDER BY md5(concat('7-', cast(sample_index AS STR))), sample_index) <= 100 AS chosen FROM sequences")
def smp02(spark, d):
    return sampling.subsample(view(spark, d, "sequences").select("sample_index"), "sample_index", 100, 7)


@query(
    "smp03_shuffled_rows",
    "SELECT sample_index, string_agg(substr(sequence, cast(p AS int), 1), '' ORDER BY md5(concat('3-', cast(sample_index AS STR), '-', cast(p AS STR)))) AS shuffled FROM sequences, (SELECT unnest(range(1, 51)) AS p) u GROUP BY 1",
)
def smp03(spark, d):
    return view(spark, d, "sequences").select("sample_index", sampling.shuffle_bases(F.col("sequence"), F.col("sample_index"), 3).alias("shuffled"))


@query("smp04_pair_sample")
def smp04(spark, d):
    """2048 pairs of distinct rows in hash order, for a kernel's bandwidth: mean squared feature distance."""
    from helixframe.models.features import mean_squared_distance

    return spark.createDataFrame([(round(mean_squared_distance(view(spark, d, "labelled"), 2048, 3), 6),)], "mean_squared_distance double")
