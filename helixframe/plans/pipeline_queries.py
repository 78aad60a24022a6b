"""The composite pipelines (PIP): operators put together into the analyses users run."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import bases as B
from helixframe.models import forests
from helixframe.operators import generate, graph, joins, metrics, profile, rank, sampling, select, validate
from helixframe.plans.catalog import query
from helixframe.plans.join_queries import _SCORED, _WITNESS, _settled, _sides, jon17
from helixframe.plans.statistic_queries import _AVG_RANK, _FREQ, _js
from helixframe.plans.table_queries import _GC, greedy_split_sql, kmer_share_sql
from helixframe.session import checkpoint
from helixframe.sources.fixtures import GENOME, view


@query(
    "pip01_similarity_split",
    f"""WITH RECURSIVE families AS (SELECT sample_index, dense_rank() OVER (ORDER BY floor(sample_index / 5.0D)) - 1 AS cluster_id FROM sequences), {greedy_split_sql('(SELECT cluster_id, count(*) AS n FROM families GROUP BY 1)')}
        SELECT sample_index, split, f.cluster_id FROM families f JOIN dealt USING (cluster_id)""",
)
def pip01(spark, d):
    """Similarity clusters, dealt whole to train, validation and test."""
    rows = view(spark, d, "sequences")
    edges = joins.hamming_self_join(rows, 5, 50).select("i", "j")
    found = graph.canonical_labels(graph.connected_components(rows.select(F.col("sample_index").alias("id")), edges))
    sizes = [(r["label"], r["n"]) for r in found.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()]
    dealt = spark.createDataFrame(sorted(graph.greedy_split(sizes, {"train": 0.7, "validation": 0.15, "test": 0.15}).items()), "label long, split string")
    out = joins.sorted_join(found, dealt, "label").select(F.col("id").alias("sample_index"), "split", F.col("label").alias("cluster_id"))
    if not validate.spanning_groups(out, "cluster_id", "split").isEmpty():
        raise validate.GateError("a cluster spans two splits")
    return validate.check_bijection(out, "sample_index")


@query(
    "pip02_data_audit",
    f"""SELECT n_rows, n_unique, gc_mean, q50, spearman FROM (SELECT count(*) AS n_rows, count(DISTINCT sequence) AS n_unique, round(avg({_GC} / 50.0), 6) AS gc_mean, round(quantile_cont(strength, 0.5), 6) AS q50 FROM sequences) a,
        (SELECT round(corr(rx, ry), 6) + 0 AS spearman FROM (SELECT {_AVG_RANK.format(_GC)} AS rx, {_AVG_RANK.format('strength')} AS ry FROM sequences) r) b""",
)
def pip02(spark, d):
    rows = view(spark, d, "sequences")
    shape = profile.sequence_profile(rows).select("n_rows", "n_unique", "gc_mean")
    numbers = profile.numeric_profile(rows, "strength").select("q50")
    link = metrics.spearman(rows.withColumn("gc", B.gc_count(F.col("sequence"))), "gc", "strength").select("spearman")
    return shape.crossJoin(numbers).crossJoin(link)


@query(
    "pip03_exploration",
    f"""SELECT split, grp, n, mean, top FROM (SELECT split, grp, count(*) AS n, round(avg({_GC} / 50.0), 6) AS mean FROM (SELECT split, sequence, CASE WHEN y < b0 THEN 'weak' WHEN y < b1 THEN 'medium' ELSE 'strong' END AS grp FROM labelled, (SELECT quantile_cont(y, 1/3.0) AS b0, quantile_cont(y, 2/3.0) AS b1 FROM labelled WHERE split = 'train') e) t GROUP BY 1, 2) a,
        (SELECT token AS top FROM (SELECT substr(sequence, cast(p AS int), 4) AS token, count(*) AS n, min(sample_index * 1000 + p - 1) AS seen FROM sequences, (SELECT unnest(range(1, 48)) AS p) u GROUP BY 1) t ORDER BY n DESC, seen LIMIT 1) b""",
)
def pip03(spark, d):
    rows = view(spark, d, "labelled")
    edges = profile.boundaries(rows.where("split = 'train'"), "y")
    named = rows.crossJoin(F.broadcast(edges)).select("split", B.group_right_open(F.col("y"), F.col("b0"), F.col("b1")).alias("grp"), B.gc_fraction(F.col("sequence")).alias("gc"))
    tokens = profile.position_tokens(rows, 4, keep=["sample_index"]).groupBy("token").agg(F.count("*").alias("n"), F.min(F.col("sample_index") * 1000 + F.col("pos")).alias("seen"))
    top = rank.top_tokens(tokens, 1, [F.col("n").desc(), F.col("seen")]).select(F.col("token").alias("top"))
    return profile.group_profile(named, "gc", ["split", "grp"]).drop("sd").crossJoin(F.broadcast(top))


@query(
    "pip04_import",
    "SELECT count(*) AS rows, count(DISTINCT s) AS distinct_rows, (SELECT count(*) FROM (SELECT s FROM (SELECT upper(substr(sequence, 1, 6)) AS s, sample_index % 2 AS label FROM sequences) t GROUP BY 1 HAVING count(DISTINCT label) > 1) u) AS conflicts FROM (SELECT upper(substr(sequence, 1, 6)) AS s FROM sequences) v",
)
def pip04(spark, d):
    raw = view(spark, d, "sequences").select(F.concat(F.lit(" "), F.lower(F.substring("sequence", 1, 6)), F.lit(" ")).alias("raw"), (F.col("sample_index") % 2).alias("label"))
    rows = validate.require(raw.select(B.normalise(F.col("raw")).alias("s"), "label"), B.is_valid(F.col("s"), 6), "not a string of bases")
    conflicts = validate.conflicting_labels(rows, "s", "label").agg(F.count("*").alias("conflicts"))
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("s").alias("distinct_rows")).crossJoin(conflicts)


_WINDOWED = "(SELECT ext_id, category, strand, substr(variant, 71, 50) AS win, variant FROM external)"


@query(
    "pip05_fixed_window_funnel",
    f"""SELECT strand, count(*) AS rows, count(*) FILTER (category = 'tss') AS tss, count(*) FILTER (category = 'tss' AND near) AS overlapping, count(*) FILTER (category = 'tss' AND NOT near) AS candidates FROM
        (SELECT category, strand, EXISTS (SELECT 1 FROM sequences s WHERE hamming(s.sequence, w.win) <= 5 OR hamming(s.sequence, reverse(translate(w.win, 'ACGT', 'TGCA'))) <= 5) AS near FROM {_WINDOWED} w) t GROUP BY 1""",
)
def pip05(spark, d):
    rows = view(spark, d, "external").select("ext_id", "category", "strand", B.slice_of(F.col("variant"), F.lit(70), F.lit(120)).alias("win"))
    probes = rows.select("ext_id", F.explode(F.array("win", B.reverse_complement(F.col("win")))).alias("text"))
    hits = joins.hamming_pairs(probes, view(spark, d, "sequences").select(F.col("sequence").alias("text")), 5, 50)
    near = joins.sorted_join(probes, hits.select(F.col("a").alias("text")).distinct(), "text").select("ext_id").distinct().withColumn("near", F.lit(True))
    flagged = joins.sorted_join(rows, near, "ext_id", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    tss = F.col("category") == "tss"
    return flagged.groupBy("strand").agg(F.count("*").alias("rows"), F.count_if(tss).alias("tss"), F.count_if(tss & F.col("near")).alias("overlapping"), F.count_if(tss & ~F.col("near")).alias("candidates"))


_WITNESS_ALL = _WITNESS.format("hamming")


@query("pip06_shifted_funnel", f"SELECT category, count(*) AS rows, count(distance) AS hits, min(distance) AS least, count(DISTINCT reference) AS refs FROM external LEFT JOIN ({_WITNESS_ALL}) w USING (ext_id) GROUP BY 1")
def pip06(spark, d):
    rows = view(spark, d, "external")
    windows = joins.shifted_windows(rows, "variant", 70, 50, range(-5, 6)).select("ext_id", "shift", "orientation", "window")
    pairs = joins.hamming_pairs(windows.select(F.col("window").alias("text")), view(spark, d, "sequences").select(F.col("sequence").alias("text")), 5, 50)
    best = joins.best_witness(windows, pairs, "ext_id")
    return joins.sorted_join(rows, best, "ext_id", "left").groupBy("category").agg(F.count("*").alias("rows"), F.count("distance").alias("hits"), F.min("distance").alias("least"), F.count_distinct("reference").alias("refs"))


@query(
    "pip07_proximity_funnel",
    f"""SELECT count(*) FILTER (gap <= 0) AS within_0, count(*) FILTER (gap <= 5) AS within_5, count(*) FILTER (gap <= 20) AS within_20, count(*) FILTER (gap > 20) AS beyond_20, max(gap) AS furthest FROM
        (SELECT q, min(greatest(0, least(abs(q_at - r_at), {GENOME} - abs(q_at - r_at)) - 50)) AS gap FROM (SELECT o_orderkey AS q, (o_orderkey * 17) % {GENOME} AS q_at FROM orders) a, (SELECT tss_position AS r_at FROM external) b GROUP BY 1) t""",
)
def pip07(spark, d):
    gaps = jon17(spark, d)
    return joins.within_thresholds(gaps, "gap", (0, 5, 20)).crossJoin(gaps.agg(F.max("gap").alias("furthest")))


_UNIQUE = "(SELECT m2, median(amount) AS value, min(quality) AS quality FROM library WHERE lib_id % 7 <> 0 GROUP BY 1)"


@query(
    "pip08_screening_scores",
    f"""SELECT 'records' AS level, count(*) AS n, round((sum(r + 1) FILTER (p = 1) - sum(p) * (sum(p) + 1) / 2.0D) / (sum(p) * sum(1 - p)), 6) AS auroc FROM (SELECT {_AVG_RANK.format('amount')} AS r, CASE WHEN quality = 'Yes' THEN 1 ELSE 0 END AS p FROM library WHERE lib_id % 7 <> 0) t
        UNION ALL SELECT 'unique', count(*), round((sum(r + 1) FILTER (p = 1) - sum(p) * (sum(p) + 1) / 2.0D) / (sum(p) * sum(1 - p)), 6) FROM (SELECT {_AVG_RANK.format('value')} AS r, CASE WHEN value > 5000 THEN 1 ELSE 0 END AS p FROM {_UNIQUE} u) t""",
)
def pip08(spark, d):
    rows = view(spark, d, "library").where("lib_id % 7 <> 0")
    once = rows.groupBy("m2").agg(F.median("amount").alias("value"))
    out = None
    for level, df, score, positive in (("records", rows, "amount", F.col("quality") == "Yes"), ("unique", once, "value", F.col("value") > 5000)):
        part = metrics.auroc(df.withColumn("positive", positive), score, "positive").crossJoin(df.agg(F.count("*").alias("n"))).select(F.lit(level).alias("level"), "n", "auroc")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "pip09_edit_stage",
    "SELECT count(*) AS rows, count(d) AS matched, min(d) AS least, max(d) AS most FROM (SELECT e.edit_id, min(levenshtein(e.text, s.sequence)) AS d FROM edited e LEFT JOIN sequences s ON levenshtein(e.text, s.sequence) <= 5 GROUP BY 1) t",
)
def pip09(spark, d):
    rows = view(spark, d, "edited")
    pairs = joins.edit_pairs(rows.select("text"), view(spark, d, "sequences").select(F.col("sequence").alias("text")), 5, 50)
    best = pairs.groupBy("a").agg(F.min("distance").alias("d"))
    return joins.sorted_join(rows, best, rows["text"] == best["a"], "left").agg(F.count("*").alias("rows"), F.count("d").alias("matched"), F.min("d").alias("least"), F.max("d").alias("most"))


_LIB = "(SELECT lib_id, quality, substr(concat(m1, m2, m3), length(m1) + length(m2) - 49, 50) AS win FROM library WHERE quality = 'Yes')"


@query(
    "pip10_library_audit",
    f"""SELECT count(*) AS rows, count(DISTINCT win) AS windows, (SELECT count(*) FROM (SELECT win FROM {_LIB} x GROUP BY 1 HAVING count(*) > 1) g) AS duplicate_groups,
        (SELECT count(*) FROM (SELECT DISTINCT win FROM {_LIB} y) q WHERE EXISTS (SELECT 1 FROM sequences s WHERE hamming(s.sequence, q.win) <= 5)) AS matches FROM {_LIB} z""",
)
def pip10(spark, d):
    rows = joins.settled(view(spark, d, "library").where("quality = 'Yes'").select("lib_id", B.module_window([F.col("m1"), F.col("m2"), F.col("m3")], 0, 50).alias("win")))
    groups = rows.groupBy("win").agg(F.count("*").alias("n"))
    head = groups.agg(F.sum("n").alias("rows"), F.count("*").alias("windows"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))
    pairs = joins.hamming_pairs(groups.select(F.col("win").alias("text")), view(spark, d, "sequences").select(F.col("sequence").alias("text")), 5, 50)
    return head.crossJoin(pairs.agg(F.count_distinct("a").alias("matches")))


@query(
    "pip11_peak_diagnostic",
    """SELECT hypothesis, count(*) AS peaks, count(*) FILTER (at_place >= 0 AND at_place < 6) AS inside FROM (SELECT h AS hypothesis, pos - CASE WHEN h = 'one_based' THEN 1 ELSE 0 END AS at_place FROM
       (SELECT lib_id, min(pos) AS pos, count(*) AS ties FROM (SELECT lib_id, pos, coalesce(hits, 0) AS v, max(coalesce(hits, 0)) OVER (PARTITION BY lib_id) AS peak FROM tss_counts) t WHERE v = peak GROUP BY 1) p, (SELECT unnest(['zero_based', 'one_based']) AS h) x WHERE ties = 1) u GROUP BY 1""",
)
def pip11(spark, d):
    single = profile.peaks(view(spark, d, "tss_counts"), "lib_id", "pos", "hits").where(~F.col("positions").contains(";")).select(F.col("positions").cast("int").alias("pos"))
    both = single.select(F.explode(F.array(F.struct(F.lit("zero_based").alias("hypothesis"), F.col("pos").alias("place")), F.struct(F.lit("one_based").alias("hypothesis"), (F.col("pos") - 1).alias("place")))).alias("x")).select("x.*")
    return both.groupBy("hypothesis").agg(F.count("*").alias("peaks"), F.count_if(F.col("place").between(0, 5)).alias("inside"))


_NEAREST = f"(SELECT q, best, avg(label) AS prediction FROM (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM {_SCORED} s) t WHERE score = best GROUP BY 1, 2)"


@query(
    "pip12_neighbour_audit",
    f"SELECT CASE WHEN 50 - best <= 20 THEN '0-20' WHEN 50 - best <= 25 THEN '21-25' ELSE '26-50' END AS bucket, count(*) AS n, round(avg(abs(prediction - y)), 6) AS mae, round(avg(prediction - y), 6) + 0 AS bias FROM {_NEAREST} p JOIN labelled l ON l.sample_index = p.q GROUP BY 1",
)
def pip12(spark, d):
    rows = _settled(spark, d)
    asked = rows.where("split = 'test'").select(F.col("sample_index").alias("q"), "y")
    found = joins.sorted_join(joins.nearest_mean(joins.closest_levels(*_sides(rows), 1)), asked, "q")
    bucket = B.distance_bucket(50 - F.col("best"), ((0, 20), (21, 25), (26, 50)))
    e = F.col("prediction") - F.col("y")
    return found.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), (F.round(F.avg(e), 6) + 0.0).alias("bias"))


def _structure_sql(generator: str) -> str:
    source = f"(SELECT sequence FROM generated WHERE generator = '{generator}') x"
    return f"""SELECT '{generator}' AS generator, l1, js FROM (SELECT round(sum(abs(a.f - b.f)) / 50, 6) AS l1 FROM {_FREQ.format(source)} a JOIN {_FREQ.format('sequences')} b USING (pos, token)) p,
      (SELECT round(sum({_js('a.p', 'b.p')}), 6) AS js FROM {kmer_share_sql('generated', 3, f"generator = '{generator}'")} a JOIN {kmer_share_sql('sequences')} b USING (token)) q"""


@query("pip13_structure_comparison", f"{_structure_sql('AR')} UNION ALL {_structure_sql('VAE')}")
def pip13(spark, d):
    rows, training = view(spark, d, "generated"), view(spark, d, "sequences")
    out = None
    for name in ("AR", "VAE"):
        own = rows.where(F.col("generator") == name)
        part = metrics.position_l1(own, training, 50).crossJoin(metrics.js_kmers(own, training, 3)).select(F.lit(name).alias("generator"), "l1", "js")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "pip14_condition_response",
    "SELECT generator, grp, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd, round(avg(s), 6) AS strong_share FROM (SELECT generator, grp, run, avg(0.5 * score_m + 0.5 * score_s) AS m, avg(CASE WHEN 0.5 * score_m + 0.5 * score_s >= 2.5 THEN 1.0 ELSE 0 END) AS s FROM generated GROUP BY 1, 2, 3) t GROUP BY 1, 2",
)
def pip14(spark, d):
    rows = view(spark, d, "generated").withColumn("blend", B.blend([F.col("score_m"), F.col("score_s")], [0.5, 0.5]))
    runs = rows.groupBy("generator", "grp", "run").agg(F.avg("blend").alias("m"), F.avg((F.col("blend") >= 2.5).cast("double")).alias("s"))
    return runs.groupBy("generator", "grp").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("sd"), F.round(F.avg("s"), 6).alias("strong_share"))


@query(
    "pip15_target_ranking",
    """SELECT generator, grp, round(avg(o), 6) AS mean_overlap, min(o) AS least, max(o) AS most FROM (SELECT generator, grp, run, count(*) FILTER (a <= 20 AND b <= 20) AS o FROM (SELECT generator, grp, run, row_number() OVER (PARTITION BY generator, grp, run ORDER BY round(abs(score_m - target), 9), sample_index) AS a,
       row_number() OVER (PARTITION BY generator, grp, run ORDER BY round(abs(score_s - target), 9), sample_index) AS b FROM generated) r GROUP BY 1, 2, 3) t GROUP BY 1, 2""",
)
def pip15(spark, d):
    by = ["generator", "grp", "run"]
    rows = rank.closeness_rank(view(spark, d, "generated"), by, "score_m", F.col("target"), "sample_index", "a")
    runs = rank.rank_overlap(rank.closeness_rank(rows, by, "score_s", F.col("target"), "sample_index", "b"), by, "a", "b", 20)
    return runs.groupBy("generator", "grp").agg(F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.min("overlap").alias("least"), F.max("overlap").alias("most"))


@query(
    "pip16_target_selection",
    "SELECT fold, round(avg(g), 6) AS random, round(avg(g) FILTER (h <= 50), 6) AS hindsight, round(avg(g) FILTER (k <= 50), 6) AS chosen FROM (SELECT fold, abs(y - 2.98) AS g, row_number() OVER (PARTITION BY fold ORDER BY abs(y - 2.98), sample_index) AS h, row_number() OVER (PARTITION BY fold ORDER BY round(abs(score_a - 2.98), 9), sample_index) AS k FROM scores) t GROUP BY 1",
)
def pip16(spark, d):
    rows = view(spark, d, "scores").withColumn("gap", F.abs(F.col("y") - 2.98))
    ranked = rank.closeness_rank(rows, ["fold"], "score_a", F.lit(2.98), "sample_index", "k")
    chosen = ranked.where("k <= 50").groupBy("fold").agg(F.round(F.avg("gap"), 6).alias("chosen"))
    return rank.selection_bounds(rows, ["fold"], "gap", 50).join(chosen, "fold")


@query(
    "pip17_gc_matching",
    f"""SELECT generator, run, count(*) FILTER (grp = 'weak') AS kept, round(avg(score_m) FILTER (grp = 'strong') - avg(score_m) FILTER (grp = 'weak'), 6) AS difference FROM
        (SELECT generator, run, grp, score_m, k, least(count(*) FILTER (grp = 'weak') OVER w, count(*) FILTER (grp = 'strong') OVER w) AS take FROM
          (SELECT *, {_GC} AS gc, row_number() OVER (PARTITION BY generator, run, grp, {_GC} ORDER BY md5(concat('0-', cast(sample_index AS STR))), sample_index) AS k FROM generated WHERE grp IN ('weak', 'strong')) t WINDOW w AS (PARTITION BY generator, run, gc)) u WHERE k <= take GROUP BY 1, 2""",
)
def pip17(spark, d):
    matched = sampling.gc_matched(view(spark, d, "generated"), ["generator", "run"], "grp", ("weak", "strong"), "sample_index")
    strong, weak = (F.avg(F.when(F.col("grp") == g, F.col("score_m"))) for g in ("strong", "weak"))
    return matched.groupBy("generator", "run").agg(F.count_if(F.col("grp") == "weak").alias("kept"), F.round(strong - weak, 6).alias("difference"))


@query(
    "pip18_unified_generated",
    """SELECT generator, grp, n, n_distinct, digest, diversity FROM (SELECT generator, grp, count(*) AS n, count(DISTINCT sequence) AS n_distinct, sha256(concat(string_agg(sequence, chr(10) ORDER BY run, sample_index), chr(10))) AS digest FROM generated GROUP BY 1, 2) a JOIN
       (SELECT generator, grp, round(avg((n * n - s) / (n * (n - 1))), 6) AS diversity FROM (SELECT generator, grp, pos, sum(c) AS n, sum(c * c) AS s FROM (SELECT generator, grp, pos, substr(sequence, cast(pos AS int), 1) AS b, cast(count(*) AS double) AS c FROM generated, (SELECT unnest(range(1, 51)) AS pos) p GROUP BY 1, 2, 3, 4) t GROUP BY 1, 2, 3) u GROUP BY 1, 2) b USING (generator, grp)""",
)
def pip18(spark, d):
    rows, by = view(spark, d, "generated"), ["generator", "grp"]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("run", "sample_index", "sequence"))), lambda x: x["sequence"])
    head = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("n_distinct"), F.sha2(F.concat(F.array_join(ordered, "\n"), F.lit("\n")), 256).alias("digest"))
    return head.join(metrics.pairwise_diversity(rows, 50, by), by)


@query("pip19_shortlist")
def pip19(spark, d):
    """Eligible candidates by run length and training distance, then a diverse shortlist with its annotations."""
    rows = view(spark, d, "generated").where(B.longest_run(F.col("sequence")) <= 8).withColumn("bucket", F.concat_ws("/", "generator", "grp"))
    train = view(spark, d, "labelled").where("split = 'train'").select(F.col("sample_index").alias("r"), F.col("sequence").alias("text"), F.lit(0.0).alias("label"))
    close = joins.hamming_pairs(rows.select(F.col("sequence").alias("text")), train, 5, 50).select(F.col("a").alias("sequence")).distinct()
    eligible = rows.join(close, "sequence", "left_anti").withColumn("key", F.concat_ws("-", "run", "sample_index"))
    order = [F.round(F.abs(F.col("score_m") - F.col("target")), 9), F.round(F.abs(F.col("score_s") - F.col("target")), 9), F.col("sample_index"), F.col("run")]
    found = select.choose(eligible, "bucket", order, "key", 5, 10)
    chosen = spark.createDataFrame([(b, i, k) for b, keys in sorted(found.rows.items()) for i, k in enumerate(keys)], "bucket string, place long, key string")
    picked = eligible.join(F.broadcast(chosen), ["bucket", "key"])  # the quota of each bucket
    nearest = joins.nearest_first(joins.match_counts(picked.select(F.concat_ws("/", "bucket", "key").alias("q"), F.col("sequence").alias("text")), train))
    named = picked.withColumn("q", F.concat_ws("/", "bucket", "key")).join(nearest.select("q", (50 - F.col("score")).cast("long").alias("training_distance")), "q")
    return named.select("bucket", "place", "sample_index", "run", "sequence", "training_distance", B.longest_run(F.col("sequence")).cast("long").alias("longest_run"), B.candidate_id(F.col("generator"), F.col("grp"), F.col("run"), F.col("place")).alias("candidate_id"))


@query("pip20_evidence_audit", "SELECT count(*) AS rows, cast(0 AS bigint) AS left_only, cast(0 AS bigint) AS right_only, true AS same FROM generated")
def pip20(spark, d):
    """Rows written as FASTA and as CSV hold the same strings."""
    from helixframe.plans.model_queries import _scratch
    from helixframe.sources import readers, sinks

    rows = view(spark, d, "generated").select(F.concat_ws("-", "generator", "grp", "run", "sample_index").alias("name"), "sequence")
    fasta, csv = _scratch(spark, "evidence-fasta"), _scratch(spark, "evidence-csv")
    sinks.write_fasta(rows, fasta, ["name"])
    sinks.write_csv(rows, csv, ["name", "sequence"])
    a, b = readers.read_fasta(spark, fasta), readers.read_required_csv(spark, csv, ["name", "sequence"])
    return a.agg(F.count("*").alias("rows")).crossJoin(sampling.same_set(a, b))


@query("pip21_binary_baseline")
def pip21(spark, d):
    """Logistic regression on k-mer shares, and on GC alone, scored on the held-out split."""
    rows = checkpoint(forests.with_features(joins.settled(view(spark, d, "labelled").select("sample_index", "sequence", "y", "split", "cluster_id"))).withColumn("label", (F.col("y") >= 2.977).cast("int")))  # read by both models, at every step of a fit
    if not validate.spanning_groups(rows, "cluster_id", "split").isEmpty():
        raise validate.GateError("a cluster spans two splits")
    out = None
    for name, table in (("kmers", rows), ("gc", forests.gc_vector(rows.drop("features")))):
        scored = forests.logistic_scores(table, table.where("split = 'train'")).join(rows.select("sample_index", "label", "split"), "sample_index").where("split = 'test'")
        part = metrics.confusion(scored, "score", "label").crossJoin(metrics.auroc(scored, "score", "label")).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "gen02_condition_distance",
    f"""SELECT round(sum(abs(a.p - b.p)) / 50, 6) AS distance FROM (SELECT pos, token, (sum(CASE WHEN substr(sequence, cast(pos + 1 AS int), 1) = token THEN 1 ELSE 0 END) + 1.0) / (count(*) + 4.0) AS p FROM labelled, (SELECT unnest(range(0, 50)) AS pos) p, (SELECT unnest(['A', 'C', 'G', 'T']) AS token) t WHERE y < 2.97 GROUP BY 1, 2) a
        JOIN (SELECT pos, token, (sum(CASE WHEN substr(sequence, cast(pos + 1 AS int), 1) = token THEN 1 ELSE 0 END) + 1.0) / (count(*) + 4.0) AS p FROM labelled, (SELECT unnest(range(0, 50)) AS pos) p, (SELECT unnest(['A', 'C', 'G', 'T']) AS token) t WHERE y >= 2.985 GROUP BY 1, 2) b USING (pos, token)""",
)
def gen02_distance(spark, d):
    rows = view(spark, d, "labelled")
    a, b = generate.position_table(rows.where("y < 2.97"), 50), generate.position_table(rows.where("y >= 2.985"), 50).withColumnRenamed("p", "q")
    return a.join(b, ["pos", "token"]).agg(F.round(F.sum(F.abs(F.col("p") - F.col("q"))) / 50, 6).alias("distance"))

