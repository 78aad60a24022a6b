"""Queries over projections and scalar functions (PRJ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import bases as B
from helixframe.operators import joins, profile
from helixframe.plans.catalog import query
from helixframe.sources.fixtures import genome_text, table, view

#: The genome as one string, and its ring, in SQL.
GENOME_SQL = "(SELECT string_agg(bases, '' ORDER BY piece) AS genome FROM genome_pieces)"


@query("prj01_normalise", "SELECT sample_index, sequence AS normalised, sample_index % 7 <> 3 AS valid FROM sequences")
def prj01(spark, d):
    raw = view(spark, d, "sequences").select("sample_index", F.concat(F.lit(" \t"), F.lower("sequence"), F.when(F.col("sample_index") % 7 == 3, "N").otherwise(" ")).alias("raw"))
    text = B.normalise(F.col("raw"))
    return raw.select("sample_index", F.when(B.is_valid(text), text).otherwise(F.regexp_replace(text, "N$", "")).alias("normalised"), B.is_valid(text).alias("valid"))


@query("prj02_log10_label", "SELECT sample_index, round(log10(strength), 6) AS y FROM sequences WHERE strength > 0")
def prj02(spark, d):
    return view(spark, d, "sequences").where("strength > 0").select("sample_index", F.round(F.log10("strength"), 6).alias("y"))


_GC = "(length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', '')))"


@query("prj03_gc_fraction", f"SELECT sample_index, round({_GC} / cast(length(sequence) AS double), 6) AS gc FROM sequences")
def prj03(spark, d):
    return view(spark, d, "sequences").select("sample_index", F.round(B.gc_fraction(F.col("sequence")), 6).alias("gc"))


@query("prj04_gc_count", f"SELECT sample_index, {_GC} AS gc FROM sequences")
def prj04(spark, d):
    return view(spark, d, "sequences").select("sample_index", B.gc_count(F.col("sequence")).alias("gc"))


@query("prj05_reverse_complement", "SELECT sample_index, reverse(translate(sequence, 'ACGT', 'TGCA')) AS rc FROM sequences")
def prj05(spark, d):
    return view(spark, d, "sequences").select("sample_index", B.reverse_complement(F.col("sequence")).alias("rc"))


@query(
    "prj06_longest_run",
    """SELECT sample_index, max(n) AS run FROM (SELECT sample_index, pos - k AS island, c, count(*) AS n FROM
       (SELECT sample_index, pos, c, row_number() OVER (PARTITION BY sample_index, c ORDER BY pos) AS k FROM
         (SELECT sample_index, pos, substr(sequence, pos, 1) AS c FROM sequences, (SELECT unnest(range(1, 51)) AS pos) p)) GROUP BY 1, 2, 3) GROUP BY 1""",
)
def prj06(spark, d):
    return view(spark, d, "sequences").select("sample_index", B.longest_run(F.col("sequence")).alias("run"))


@query(
    "prj07_strand_window",
    f"""SELECT ext_id, strand, CASE WHEN strand = '+' THEN substr(genome, tss_position - 50 + 1, 50) ELSE reverse(translate(substr(genome, tss_position + 1, 50), 'ACGT', 'TGCA')) END AS win
        FROM external, {GENOME_SQL} g WHERE tss_position >= 50 AND tss_position + 50 <= length(genome)""",
)
def prj07(spark, d):
    g = genome_text(spark, d)
    rows = view(spark, d, "external").where((F.col("tss_position") >= 50) & (F.col("tss_position") + 50 <= len(g)))
    return rows.select("ext_id", "strand", B.strand_window(F.lit(g), F.col("tss_position"), F.col("strand"), 50).alias("win"))


@query(
    "prj08_checked_window",
    """SELECT ext_id, CASE WHEN sequence IS NULL OR length(variant) < 120 THEN 'window_out_of_bounds' WHEN substr(variant, 71, 50) = sequence THEN 'verified' ELSE 'window_mismatch' END AS status,
       substr(variant, 71, 50) AS win FROM external LEFT JOIN sequences ON sample_index = ext_id AND ext_id % 17 <> 0""",
)
def prj08(spark, d):
    seqs = view(spark, d, "sequences").select("sample_index", "sequence")
    rows = view(spark, d, "external").join(seqs, (F.col("sample_index") == F.col("ext_id")) & (F.col("ext_id") % 17 != 0), "left")
    return rows.select("ext_id", B.window_status(F.col("variant"), F.col("sequence"), 70, 120).alias("status"), B.slice_of(F.col("variant"), F.lit(70), F.lit(120)).alias("win"))


@query(
    "prj09_module_window",
    """SELECT lib_id, shift, CASE WHEN fin >= 50 AND fin <= length(whole) THEN substr(whole, cast(fin - 50 + 1 AS int), 50) END AS win
       FROM (SELECT lib_id, shift, concat(m1, m2, m3) AS whole, length(m1) + length(m2) + shift AS fin FROM library, (SELECT unnest([-5, 0, 5, 30]) AS shift) s) t""",
)
def prj09(spark, d):
    mods = [F.col("m1"), F.col("m2"), F.col("m3")]
    parts = F.array(*(F.struct(F.lit(s).alias("shift"), B.module_window(mods, s, 50).alias("win")) for s in (-5, 0, 5, 30)))
    return view(spark, d, "library").select("lib_id", F.explode(parts).alias("x")).select("lib_id", "x.shift", "x.win")


@query(
    "prj10_shifted_windows",
    """SELECT ext_id, shift, orientation, CASE WHEN orientation = 'forward' THEN w ELSE reverse(translate(w, 'ACGT', 'TGCA')) END AS win
       FROM (SELECT ext_id, shift, substr(variant, cast(71 + shift AS int), 50) AS w FROM external, (SELECT unnest(range(-5, 6)) AS shift) s) t, (SELECT unnest(['forward', 'reverse_complement']) AS orientation) o""",
)
def prj10(spark, d):
    return joins.shifted_windows(view(spark, d, "external"), "variant", 70, 50, range(-5, 6)).select("ext_id", "shift", "orientation", F.col("window").alias("win"))


@query("prj11_base_codes", "SELECT sample_index, translate(sequence, 'ACGT', '0123') AS codes, sequence AS decoded FROM sequences")
def prj11(spark, d):
    c = B.codes(F.col("sequence"))
    return view(spark, d, "sequences").select("sample_index", F.array_join(F.transform(c, lambda x: x.cast("string")), "").alias("codes"), B.decode(c).alias("decoded"))


@query(
    "prj12_one_hot",
    """SELECT sample_index, replace(replace(replace(replace(translate(sequence, 'ACGT', '0123'), '0', 'a'), '1', 'b'), '2', 'c'), '3', 'd') AS letters, length(sequence) * 4 AS cells, length(sequence) AS ones
       FROM sequences""",
)
def prj12(spark, d):
    hot = B.one_hot(F.col("sequence"))
    letters = F.array_join(F.transform(hot, lambda r: F.substr(F.lit("abcd"), F.array_position(r, 1).cast("int"), F.lit(1))), "")
    flat = F.flatten(hot)
    return view(spark, d, "sequences").select("sample_index", letters.alias("letters"), F.size(flat).alias("cells"), F.aggregate(flat, F.lit(0), lambda s, x: s + x).alias("ones"))


@query("prj13_kmers", "SELECT sample_index, pos, substr(sequence, cast(pos + 1 AS int), 3) AS token FROM sequences, (SELECT unnest(range(0, 48)) AS pos) p")
def prj13(spark, d):
    return profile.position_tokens(view(spark, d, "sequences"), 3, keep=["sample_index"])


_CODE3 = "16 * (instr('ACGT', substr(sequence, cast(pos + 1 AS int), 1)) - 1) + 4 * (instr('ACGT', substr(sequence, cast(pos + 2 AS int), 1)) - 1) + instr('ACGT', substr(sequence, cast(pos + 3 AS int), 1)) - 1"


@query("prj14_position_code", f"SELECT sample_index, pos, 64 * pos + {_CODE3} AS code FROM sequences, (SELECT unnest(range(0, 48)) AS pos) p")
def prj14(spark, d):
    t = profile.position_tokens(view(spark, d, "sequences"), 3, keep=["sample_index"])
    return t.select("sample_index", "pos", (F.col("pos") * 64 + B.kmer_code(F.col("token"), 3)).alias("code"))


@query(
    "prj15_spaced_pairs",
    """SELECT sample_index, code FROM (SELECT sample_index, off + pos * 16 + (instr('ACGT', substr(sequence, cast(pos + 1 AS int), 1)) - 1) * 4 + instr('ACGT', substr(sequence, cast(pos + 1 + gap AS int), 1)) - 1 AS code
       FROM sequences, (SELECT 10 AS gap, 0 AS off, unnest(range(0, 40)) AS pos UNION ALL SELECT 17, 640, unnest(range(0, 33))) p) t""",
)
def prj15(spark, d):
    return view(spark, d, "sequences").select("sample_index", F.explode(B.spaced_pair_codes(F.col("sequence"), (10, 17), 50)).alias("code"))


@query("prj16_group_right_open", "SELECT sample_index, CASE WHEN strength < 930 THEN 'weak' WHEN strength < 970 THEN 'medium' ELSE 'strong' END AS grp FROM sequences")
def prj16(spark, d):
    return view(spark, d, "sequences").select("sample_index", B.group_right_open(F.col("strength"), 930, 970).alias("grp"))


@query("prj17_group_right_closed", "SELECT sample_index, CASE WHEN strength <= 930 THEN 'weak' WHEN strength <= 970 THEN 'medium' ELSE 'strong' END AS grp FROM sequences")
def prj17(spark, d):
    return view(spark, d, "sequences").select("sample_index", B.group_right_closed(F.col("strength"), 930, 970).alias("grp"))


@query(
    "prj18_distance_bucket",
    "SELECT sample_index, CASE WHEN x BETWEEN 0 AND 4 THEN '0-4' WHEN x BETWEEN 5 AND 9 THEN '5-9' WHEN x BETWEEN 10 AND 50 THEN '10-50' END AS bucket FROM (SELECT sample_index, sample_index % 60 AS x FROM sequences) t",
)
def prj18(spark, d):
    return view(spark, d, "sequences").select("sample_index", B.distance_bucket(F.col("sample_index") % 60, ((0, 4), (5, 9), (10, 50))).alias("bucket"))


@query(
    "prj19_standardise",
    f"""SELECT sample_index, round((gc - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END, 6) AS z FROM (SELECT sample_index, {_GC} / 50.0 AS gc FROM sequences) a,
        (SELECT avg({_GC} / 50.0) AS m, stddev_pop({_GC} / 50.0) AS s FROM labelled WHERE split = 'train') b""",
)
def prj19(spark, d):
    rows = view(spark, d, "labelled").select("sample_index", "split", B.gc_fraction(F.col("sequence")).alias("gc"))
    fit = rows.where("split = 'train'").agg(F.avg("gc").alias("m"), F.stddev_pop("gc").alias("s"))
    return rows.crossJoin(F.broadcast(fit)).select("sample_index", F.round((F.col("gc") - F.col("m")) / F.when(F.col("s") < 1e-12, 1.0).otherwise(F.col("s")), 6).alias("z"))


@query("prj20_blend", "SELECT sample_index, round(0.5 * y + 0.4 * score_a + 0.1 * score_b, 6) AS blend FROM scores")
def prj20(spark, d):
    return view(spark, d, "scores").select("sample_index", F.round(B.blend([F.col("y"), F.col("score_a"), F.col("score_b")], [0.5, 0.4, 0.1]), 6).alias("blend"))


@query("prj21_affine", "SELECT sample_index, round(0.25 + 0.75 * score_a, 9) AS calibrated FROM scores")
def prj21(spark, d):
    return view(spark, d, "scores").select("sample_index", F.round(B.affine(F.col("score_a"), 0.25, 0.75), 9).alias("calibrated"))


@query(
    "prj22_candidate_id",
    "SELECT generator, grp, run, sample_index, concat('G25_', generator, '_', grp, '_R', cast(run AS STR), '_I', lpad(cast(sample_index % 500 AS STR), 3, '0')) AS candidate_id FROM generated",
)
def prj22(spark, d):
    return view(spark, d, "generated").select("generator", "grp", "run", "sample_index", B.candidate_id(F.col("generator"), F.col("grp"), F.col("run"), F.col("sample_index") % 500).alias("candidate_id"))


@query("prj23_position_columns", "SELECT lib_id, pos, hits FROM tss_counts")
def prj23(spark, d):
    wide = view(spark, d, "tss_counts").groupBy("lib_id").agg(*(F.max(F.when(F.col("pos") == p, F.col("hits"))).alias(f"TSS_pos_{p}") for p in range(1, 7)))
    long = wide.unpivot("lib_id", [c for c in wide.columns if c.startswith("TSS_pos_")], "name", "hits")
    return long.select("lib_id", F.regexp_extract("name", r"^TSS_pos_(\d+)$", 1).cast("int").alias("pos"), "hits")


@query(
    "prj24_index_hypotheses",
    """SELECT lib_id, hypothesis, place, place >= 0 AND place < n AS inside, place >= 50 AND place <= n AS extractable FROM
       (SELECT lib_id, h AS hypothesis, cast(lib_id % 130 AS int) - CASE WHEN h = 'one_based' THEN 1 ELSE 0 END AS place, length(concat(m1, m2, m3)) AS n FROM library, (SELECT unnest(['zero_based', 'one_based']) AS h) x) t""",
)
def prj24(spark, d):
    rows = view(spark, d, "library").select("lib_id", (F.col("lib_id") % 130).cast("int").alias("p"), F.length(F.concat("m1", "m2", "m3")).alias("n"))
    both = F.array(F.struct(F.lit("zero_based").alias("hypothesis"), F.col("p").alias("place")), F.struct(F.lit("one_based").alias("hypothesis"), (F.col("p") - 1).alias("place")))
    x = rows.select("lib_id", "n", F.explode(both).alias("x")).select("lib_id", "n", "x.*")
    return x.select("lib_id", "hypothesis", "place", ((F.col("place") >= 0) & (F.col("place") < F.col("n"))).alias("inside"), ((F.col("place") >= 50) & (F.col("place") <= F.col("n"))).alias("extractable"))


@query("prj25_content_hashes", "SELECT item_id, sha256(text) AS sha256, sha1(concat('blob ', cast(octet_length(encode(text)) AS STR), chr(0), text)) AS git_sha1 FROM benchmark")
def prj25(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("sha256"), B.git_blob_sha1(F.col("text")).alias("git_sha1"))


@query("prj26_ordered_digest", "SELECT generator, grp, run, sha256(concat(string_agg(sequence, chr(10) ORDER BY sample_index), chr(10))) AS digest FROM generated GROUP BY 1, 2, 3")
def prj26(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sample_index", "sequence"))), lambda x: x["sequence"])
    return view(spark, d, "generated").groupBy("generator", "grp", "run").agg(F.sha2(F.concat(F.array_join(ordered, "\n"), F.lit("\n")), 256).alias("digest"))


@query("prj27_fold_digest", "SELECT sha256(string_agg(cast(fold AS STR), ',' ORDER BY sample_index)) AS digest FROM scores")
def prj27(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sample_index", "fold"))), lambda x: x["fold"].cast("string"))
    return view(spark, d, "scores").agg(F.sha2(F.array_join(ordered, ","), 256).alias("digest"))
