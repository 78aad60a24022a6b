import pytest

from helixframe.llm import mixing
from tests.llm.texts import SCHEMA, corpus, documents, split


def brute_targets(sizes):
    """Share by weight, stop at three times the size, share the rest again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), {s for s in names if sizes[s]}, float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 3, "d": 50}, {"a": 0, "b": 10, None: 7}, {"z": 5}, {"é": 10, "z": 1, "B": 500, "b": 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    wanted = brute_targets(sizes)
    assert found.keys() == wanted.keys()
    for s, t in wanted.items():
        assert found[s] == pytest.approx(t, rel=1e-9, abs=1e-6)


def test_plan(spark):
    rows = corpus()
    found = mixing.mix_plan(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes, taken = {}, {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sorted((r["size"] for r in found)) == sorted(len(split(t)) for _, t, *_ in rows)
    target = brute_targets(sizes)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix_plan(documents(spark, rows[::-1]).repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["offset"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_positions_follow_the_schedule(spark):
    df = spark.createDataFrame([(i / 100.0,) for i in range(101)], "d double")
    from pyspark.sql import functions as F

    for w0, w1 in ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5), (0.0, 2.0)):
        for r in df.select("d", mixing.position(F.col("d"), F.lit(w0), F.lit(w1)).alias("t")).collect():
            t = r["t"] or 0.0
            assert (w0 * t + (w1 - w0) / 2 * t * t) / ((w0 + w1) / 2) == pytest.approx(r["d"], abs=1e-9)


def test_mixed_documents(spark):
    rows = [(i, " ".join(f"t{i}-{k}" for k in range(20)), "en", "ab"[i % 2], 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    found = out.collect()
    plan = {r["doc_id"]: r for r in mixing.mix_plan(df).collect()}
    words = {}
    for r in found:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(split(r["text"]))
        assert rows[r["doc_id"]][1].startswith(r["text"])
    assert words == {k: p["taken"] for k, p in plan.items() if p["taken"]}
    half = len(found) // 2
    early, late = ([r["source"] for r in part].count("a") for part in (found[:half], found[half:]))
    assert early > late  # source a falls from 1.5 to 0.5


def test_repeated_rows_and_shared_ids_are_taken_as_planned(spark):
    rows = [(1, "a b c d e", "en", "s", 1)] * 2 + [(1, "f g h i j", "en", "s", 1), (2, "k l m", "de", "t", 1), (None, "n o p q", "de", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan, found = mixing.mix_plan(df).collect(), mixing.mixed_documents(df).collect()
    for source in ("s", "t", None):
        assert sum(len(split(r["text"])) for r in found if r["source"] == source) == sum(p["taken"] for p in plan if p["source"] == source)
    assert all(any(t.startswith(r["text"]) and r["doc_id"] == i and r["lang"] == lang for i, t, lang, *_ in rows) for r in found)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_query_agrees_with_its_oracle(spark, tmp_path):
    import duckdb

    from helixframe.llm import registry

    rows = [r for r in corpus() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = registry.op6_curriculum_mix(spark, str(tmp_path))
    wanted = con.execute(registry.oracle_sql()["op6_curriculum_mix"])
    names = [c[0] for c in wanted.description]
    a = sorted(str([r[c] for c in sorted(names)]) for r in found.collect())
    b = sorted(str([dict(zip(names, r, strict=True))[c] for c in sorted(names)]) for r in wanted.fetchall())
    assert a == b
