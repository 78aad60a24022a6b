"""Hand-computed values, brute force and error contracts."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import bases as B
from helixframe.operators import generate, graph, joins, metrics, profile, rank, sampling, select, validate


def _random(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def _one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_scalars(spark):
    r = _one(
        spark,
        run=B.longest_run(F.lit("AAACCCCCGT")),
        none=B.longest_run(F.lit("")),
        rc=B.reverse_complement(F.lit("AACGT")),
        gc=B.gc_count(F.lit("GGCA")),
        bad=B.is_valid(F.lit("ACGN")),
        empty=B.is_valid(F.lit("")),
        code=B.kmer_code(F.lit("TGA"), 3),
        ham=B.hamming(F.lit("ACGT"), F.lit("AGGA")),
        unequal=B.hamming(F.lit("ACGT"), F.lit("A")),
        short=B.kmers(F.lit("AC"), 3),
        sha=B.git_blob_sha1(F.lit("hello\n")),
        cid=B.candidate_id(F.lit("AR"), F.lit("weak"), F.lit(2), F.lit(7)),
    )
    assert (r["run"], r["none"], r["rc"], r["gc"], r["bad"], r["empty"], r["code"], r["ham"], r["unequal"], r["short"]) == (5, None, "ACGTT", 3, False, False, 56, 2, None, [])
    assert r["sha"] == "ce013625030ba8dba906f756967f9e9ca394464a" and r["cid"] == "G25_AR_weak_R2_I007"


def test_boundary_rules_differ_only_on_the_boundary(spark):
    rows = spark.createDataFrame([(v,) for v in (0.5, 1.0, 1.5, 2.0, 2.5)], "v double")
    found = rows.select(B.group_right_open(F.col("v"), 1.0, 2.0).alias("o"), B.group_right_closed(F.col("v"), 1.0, 2.0).alias("c")).collect()
    assert [r["o"] for r in found] == ["weak", "medium", "medium", "strong", "strong"]
    assert [r["c"] for r in found] == ["weak", "weak", "medium", "medium", "strong"]


def test_gates(spark):
    rows = spark.createDataFrame([("ACGT", 1.0), ("ACG", 2.0)], "sequence string, strength double")
    with pytest.raises(validate.GateError, match="1 strings are not 4 bases long, the first is 'ACG'"):
        validate.check_sequences(rows, 4)
    with pytest.raises(validate.GateError, match="labels"):
        validate.check_sequences(spark.createDataFrame([("ACGT", -1.0)], rows.schema), 4)
    with pytest.raises(validate.GateError, match="no sequences"):
        validate.check_sequences(rows.limit(0), 4)
    with pytest.raises(validate.GateError):
        validate.check_bijection(spark.createDataFrame([(0,), (2,)], "i long"), "i")
    with pytest.raises(validate.GateError):
        validate.check_digest("a", "b", "x")
    with pytest.raises(validate.GateError):
        validate.check_reproduced(float("nan"), 1.0, 1e-9, "x")
    with pytest.raises(validate.GateError):
        validate.check_conclusion(False, "a < b")
    with pytest.raises(ValueError):
        B.blend([F.lit(1)], [0.5])


@pytest.mark.parametrize("most", [0, 1, 5])
def test_hamming_join_equals_brute_force(spark, most):
    rng = random.Random(most)
    base = [_random(rng, 50) for _ in range(40)]
    texts = list(base)
    for t in base:
        chars = list(t)
        for k in rng.sample(range(50), rng.randint(0, 7)):
            chars[k] = rng.choice("ACGT")
        texts.append("".join(chars))
    rows = spark.createDataFrame(list(enumerate(texts)), "sample_index long, sequence string")
    wanted = {(i, j, d) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (d := sum(a != b for a, b in zip(texts[i], texts[j], strict=True))) <= most}
    found = [tuple(r) for r in joins.hamming_self_join(rows, most, 50).collect()]
    assert set(found) == wanted and len(found) == len(wanted)
    masked = {tuple(r) for r in joins.masked_self_join(rows, 50, 5, 8, most).collect()}
    assert masked == wanted


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_join_equals_brute_force(spark):
    rng = random.Random(7)
    refs = [_random(rng, 50) for _ in range(30)]
    asks = []
    for t in refs:
        s = list(t)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(s))
            what = rng.random()
            if what < 0.3:
                del s[k]
            elif what < 0.6:
                s.insert(k, rng.choice("ACGT"))
            else:
                s[k] = rng.choice("ACGT")
        asks.append("".join(s))
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    found = {tuple(r) for r in joins.edit_pairs(frame(asks), frame(refs), 5, 50).collect()}
    assert found == {(a, b, d) for a in asks for b in refs if (d := _edits(a, b)) <= 5}


def test_shifted_witness(spark):
    rng = random.Random(2)
    ref, flank = _random(rng, 50), _random(rng, 150)
    piece = list(ref)
    for k in (3, 20, 41):
        piece[k] = "ACGT"[("ACGT".index(piece[k]) + 1) % 4]
    piece = "".join(piece)
    other = piece.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    rows = spark.createDataFrame([(1, flank[:72] + piece + flank[122:]), (2, flank[:72] + other + flank[122:])], "k long, variant string")
    windows = joins.shifted_windows(rows, "variant", 70, 50, range(-5, 6))
    pairs = joins.hamming_pairs(windows.select(F.col("window").alias("text")), spark.createDataFrame([(ref,)], "text string"), 5, 50)
    found = {r["k"]: tuple(r)[1:] for r in joins.best_witness(windows, pairs, "k").collect()}
    assert found == {1: (3, 2, "forward", ref), 2: (3, 2, "reverse_complement", ref)}


def test_nearest_neighbour_tie_rules(spark):
    scored = spark.createDataFrame([(0, 0, 2.0, 9.0), (0, 1, 3.0, 8.0), (0, 2, 6.0, 8.0), (0, 3, 9.0, 8.0)], "q long, r long, label double, score double")
    fractional = joins.nearest_k_fractional(scored, 2).first()
    assert (fractional["prediction"], fractional["contributors"], fractional["boundary_ties"]) == (4.0, 4, 3)
    assert fractional["effective_size"] == pytest.approx(3.0)
    assert joins.nearest_k(scored, 2).first()["prediction"] == 2.5
    assert joins.nearest_first(scored.where("r > 0")).first()["r"] == 1
    tied = joins.nearest_mean(scored.where("r > 0")).first()
    assert (tied["ties"], tied["prediction"]) == (3, 6.0)


def test_circular_gap(spark):
    starts = spark.createDataFrame([(100,), (970,)], "start long")
    queries = spark.createDataFrame([(1, 5), (2, 110), (3, 0), (4, 999)], "q long, start long")
    found = {r["q"]: r["gap"] for r in joins.circular_gap(queries, starts, 1000, 20).collect()}
    assert found == {1: 15, 2: 0, 3: 10, 4: 9}
    assert {r["gap"] for r in joins.circular_gap(queries, starts.limit(0), 1000, 20).collect()} == {None}
    rng = random.Random(5)
    refs, asks = [rng.randrange(5000) for _ in range(12)], [rng.randrange(5000) for _ in range(200)]
    got = joins.circular_gap(spark.createDataFrame(list(enumerate(asks)), "q long, start long"), spark.createDataFrame([(r,) for r in refs], "start long"), 5000, 50)
    for r in got.collect():
        apart = min(min(abs(asks[r["q"]] - x), 5000 - abs(asks[r["q"]] - x)) for x in refs)
        assert r["gap"] == max(0, apart - 50)


def test_genome_hits_wrap_the_origin(spark):
    genome = "ACGTTGCAAGGC"
    reads = spark.createDataFrame([(1, "GGCAC"), (2, "GTGCC"), (3, "TTTTT")], "k long, text string")
    found = {tuple(r) for r in joins.genome_hits(reads, genome, 5, "k").collect()}
    assert found == {(1, 9, "+"), (2, 9, "-")}


def test_components_chain_and_labels(spark):
    nodes = spark.range(20).select(F.col("id"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(3, 12)] + [(15, 1)], "i long, j long")
    found = {r["id"]: (r["root"], r["label"]) for r in graph.canonical_labels(graph.connected_components(nodes, edges)).collect()}
    assert all(found[i][0] == 3 for i in range(3, 13)) and found[15][0] == 1
    assert [found[i][1] for i in (0, 1, 2, 3, 13, 14, 16)] == [0, 1, 2, 3, 4, 5, 6]
    summary = graph.cluster_summary(graph.connected_components(nodes, edges), edges).first()
    assert (summary["nodes"], summary["clusters"], summary["largest"], summary["forest_edges"], summary["pair_edges"]) == (20, 10, 10, 10, 10)


def test_splits_and_folds():
    sizes = [(i, n) for i, n in enumerate([10, 5, 5, 4, 3, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1])]
    split = graph.greedy_split(sizes, {"train": 0.7, "validation": 0.15, "test": 0.15})
    count = {s: sum(n for c, n in sizes if split[c] == s) for s in ("train", "validation", "test")}
    assert sum(count.values()) == 40 and abs(count["train"] - 28) <= 2
    folds = graph.greedy_folds(sizes, 3, 1)
    assert folds == graph.greedy_folds(sizes, 3, 1) and set(folds.values()) == {0, 1, 2}
    for part in graph.nested_folds(sizes, 3, 5, 1):
        assert not set(part["held_out"]) & set(part["inner"])
    assert set(graph.stratified_group_folds([(i, i % 3, 2) for i in range(20)], 4).values()) == {0, 1, 2, 3}
    rows = [(i, i % 4, 3) for i in range(40)]
    seeded = [graph.stratified_group_folds(rows, 5, seed) for seed in (1, 1, 2)]
    assert seeded[0] == seeded[1] != seeded[2] and graph.stratified_group_folds(rows, 5) not in seeded
    for found in seeded:
        shares = [sum(p for c, p, _ in rows if found[c] == f) / sum(p + n for c, p, n in rows if found[c] == f) for f in range(5)]
        assert max(shares) - min(shares) < 0.06
    parts = graph.holdout_and_folds(rows, 5, 4, 3)
    assert [list(parts.values()).count(x) for x in ("train", "validation", "test")] == [24, 8, 8]


def test_ranking_metrics(spark):
    rows = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "s double, y boolean")
    assert metrics.auroc(rows, "s", "y").first()["auroc"] == 0.875
    assert metrics.average_precision(rows, "s", "y").first()["average_precision"] == round(5 / 6, 6)
    assert metrics.auroc(rows.where("y"), "s", "y").first()["auroc"] is None


def test_closeness_ranks_and_differences(spark):
    rows = spark.createDataFrame([(i, s, "g") for i, s in enumerate([1.0, 3.0, 2.0, 2.0])], "i long, s double, g string")
    found = rank.closeness_rank(rows, ["g"], "s", F.lit(2.0), "i").orderBy("i").collect()
    assert [r["rank"] for r in found] == [3, 4, 1, 2]


def test_pairwise_diversity_closed_form(spark):
    rows = spark.createDataFrame([("AC",), ("AG",), ("TC",)], "sequence string")
    pairs = [1 / 2, 1 / 2, 2 / 2]
    assert metrics.pairwise_diversity(rows, 2).first()["diversity"] == round(sum(pairs) / 3, 6)


def test_greedy_selection():
    bucket = [("b", [(0, "AAAC"), (1, "CCCC"), (2, "GGGG")])]
    found = select.greedy_diverse(bucket, 2, 2, ["AAAA"])
    assert found.rows == {"b": [1, 2]} and found.skipped == 1
    with pytest.raises(ValueError):
        select.greedy_diverse(bucket, 3, 2, ["AAAA"])


def test_selection_widens_its_prefix(spark):
    rows = spark.createDataFrame([("b", i, "AAAA") for i in range(100)] + [("b", 200, "CCCC")], "bucket string, k long, sequence string")
    assert select.choose(rows, "bucket", [F.col("k")], "k", 2, 3, prefix=4).rows == {"b": [0, 200]}


def test_matched_sampling_and_shuffling(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, "weak" if i % 3 else "strong", _random(rng, 12), 1) for i in range(200)], "sample_index long, grp string, sequence string, run int")
    found = sampling.gc_matched(rows, ["run"], "grp", ("weak", "strong"), "sample_index").groupBy("gc").pivot("grp", ["weak", "strong"]).count().collect()
    assert found and all(r["weak"] == r["strong"] for r in found)
    mixed = rows.select("sequence", sampling.shuffle_bases(F.col("sequence"), F.col("sample_index"), 1).alias("s")).collect()
    assert all(sorted(r["sequence"]) == sorted(r["s"]) for r in mixed) and any(r["sequence"] != r["s"] for r in mixed)


def test_tables_and_samples_are_proper(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, _random(rng, 10), "ab"[i % 2]) for i in range(200)], "sample_index long, sequence string, cond string")
    table = generate.markov_table(rows, 2, 10, 0.1)
    sums = table.groupBy("cond", "pos", "context").agg(F.sum("p").alias("p"), F.count("*").alias("n")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 and r["n"] == 4 for r in sums)
    base = generate.position_table(rows, 10, 1.0, ["cond"])
    prior = generate.markov_table(rows, 2, 10, 0.1, prior=base)
    assert all(abs(r["p"] - 1) < 1e-9 for r in prior.groupBy("cond", "pos", "context").agg(F.sum("p").alias("p")).collect())
    asked = spark.range(50).select(F.col("id").alias("sample_index"), F.lit("a").alias("low"), F.lit("b").alias("high"), F.lit(0.3).alias("weight"))
    sampler = generate.MarkovSampler(table, base, 2, 10)
    first = {r["sample_index"]: r["sequence"] for r in sampler.sample(asked, 9).collect()}
    again = {r["sample_index"]: r["sequence"] for r in sampler.sample(asked.repartition(5), 9).collect()}
    assert first == again and all(len(s) == 10 and set(s) <= set("ACGT") for s in first.values())


def test_centre_weights_clamp(spark):
    centres = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "cond int, centre double")
    asked = spark.createDataFrame([(0.0,), (1.5,), (3.0,), (9.0,)], "t double")
    found = {r["t"]: (r["low"], r["high"], r["weight"]) for r in generate.centre_weights(asked, centres, "t").collect()}
    assert found == {0.0: (0, 1, 0.0), 1.5: (0, 1, 0.5), 3.0: (1, 2, 0.5), 9.0: (2, 2, 0.0)}


def test_profiles_of_odd_values(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (-1.0,), (3.0,)], "v double")
    r = profile.numeric_profile(rows, "v").first()
    assert (r["missing"], r["lowest"], r["q50"], r["highest"], r["non_positive"]) == (2, -1.0, 1.0, 3.0, 1)
    bins = {r["bin"]: r["n"] for r in profile.histogram(spark.createDataFrame([(float(i),) for i in range(31)], "v double"), "v").collect()}
    assert len(bins) == 30 and bins[30] == 2 and sum(bins.values()) == 31


def test_packed_strings(spark):
    import random

    rng = random.Random(5)
    letters = B.PACKED
    rows = []
    for _ in range(200):
        a = [rng.choice(letters) for _ in range(50)]
        b = [rng.choice(letters) if rng.random() < 0.2 else c for c in a]
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", B.packed_hamming(B.packed(F.col("a"), 50), B.packed(F.col("b"), 50)).alias("d")).collect()
    assert all(r["d"] == sum(x != y for x, y in zip(r["a"], r["b"], strict=True)) for r in got)
    with pytest.raises(Exception, match="no string of bases"):
        spark.createDataFrame([("acgt",)], "a string").select(*B.packed(F.col("a"), 4)).collect()


def test_equal_strings_pair_by_rows(spark):
    rows = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACGTACGT"), (3, "ACGTACGA"), (4, "TTTTTTTT")], "sample_index long, sequence string")
    assert sorted(tuple(r) for r in joins.hamming_self_join(rows, 1, 8).collect()) == [(1, 2, 0), (1, 3, 1), (2, 3, 1)]


def test_ranks_of_values_that_crowd_at_one_end(spark):
    values = [float(k) for k in range(500)] + [1e6, 1e9, 3.0, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = {r["i"]: r["r"] for r in metrics.with_average_rank(df, "v", "r", ranges=16).collect()}
    order = sorted(values)
    assert all(got[i] == (order.index(v) + len(order) - 1 - order[::-1].index(v)) / 2 for i, v in enumerate(values))
