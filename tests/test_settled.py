"""Strings that a join derives are written once before it, so that no plan repeats their expressions."""

from pyspark.sql import functions as F

from helixframe.operators import joins


def test_hamming_pairs_read_written_strings(spark):
    base = "ACGTTGCAAC" * 5
    rows = spark.createDataFrame([(base.lower(),), ((base[:-1] + "A").lower(),)], "raw string").select(F.upper("raw").alias("text"))
    found = joins.hamming_pairs(rows, rows, 5, 50)
    assert "upper(" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["distance"] for r in found.collect()) == [0, 0, 1, 1]


def test_feature_vectors_equal_the_shares(spark):
    from helixframe.models import forests
    from helixframe.models.features import kmer_names
    from helixframe.operators.profile import kmer_features

    rows = spark.createDataFrame([(1, "ACGTTGCAAC" * 5), (2, "A" * 50)], "sample_index long, sequence string")
    shares = {(r["sample_index"], r["feature"]): r["value"] for r in kmer_features(rows, key="sample_index").collect()}
    for r in forests.with_features(rows).collect():
        assert list(r["features"]) == [shares.get((r["sample_index"], n), 0.0) for n in kmer_names()]
