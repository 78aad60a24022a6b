import hashlib

import pytest

from helixframe.llm import substrings
from tests.llm.texts import SCHEMA, corpus, documents, split


def brute(rows, window):
    first = {}
    for doc_id, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = split(text)
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        words = split(text)
        gone = [False] * len(words)
        if doc_id is not None:
            for i in range(len(words) - window + 1):
                if first[tuple(words[i : i + window])] < doc_id:
                    gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        out.append((doc_id, len(words), sum(gone), kept))
    return out


@pytest.mark.parametrize(("window", "gram", "bits"), [(50, 8, None), (12, 4, 16), (50, 8, 16)])
def test_matches_brute_force(spark, window, gram, bits):
    rows = corpus()
    found = [tuple(r) for r in substrings.remove_repeats(documents(spark, rows), window, gram, bits).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(found, key=key) == sorted(brute(rows, window), key=key)


def test_saturated_sketch_loses_nothing(spark, monkeypatch):
    """A sketch of a few cells lets every window through: the exact stage still gives the same rows."""
    monkeypatch.setattr(substrings, "HELD", 64)
    rows = corpus(9, 40)
    found = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(documents(spark, rows), 12, 4, 5).collect()}
    assert found == {r[0]: r[2] for r in brute(rows, 12)}


def test_partial_overlap_around_a_shared_passage(spark):
    base = [f"p{i}" for i in range(80)]
    rows = [(5, " ".join(["a"] * 9 + base + ["b"] * 9), "", "", 0), (2, " ".join(["c"] * 30 + base[:70]), "", "", 0), (9, " ".join(base[20:] + ["d"] * 60), "", "", 0), (9, " ".join(base[20:] + ["d"] * 60), "", "", 0)]
    found = sorted(tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == sorted(brute(rows, 50))


def test_a_line_that_repeats_inside_many_documents(spark):
    line = " ".join(f"l{i}" for i in range(70))
    rows = [(i, " ".join([f"h{i}-{k}" for k in range(i)] + [line] * (1 + i % 4) + [f"t{i}"]), "", "", 0) for i in range(12)]
    found = sorted(tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == sorted(brute(rows, 50))


def test_rows_of_a_shared_id_lose_their_own_words(spark):
    base, other = ([f"{c}{i}" for i in range(60)] for c in "pq")
    rows = [(1, " ".join(base), "", "", 0), (2, " ".join([*base, "x"]), "", "", 0), (2, " ".join([*other, "y"]), "", "", 0), (2, "untouched text", "", "", 0), (3, " ".join([*other, "z"]), "", "", 0)]
    found = sorted(tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == sorted(brute(rows, 50))
    cut = substrings.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["text"]) for r in cut) == sorted((i, removed, kept) for i, _, removed, kept in brute(rows, 50))


def test_the_sketch_lets_few_unrepeated_anchors_through(spark):
    """Four cells an anchor in three rows: about one anchor in a hundred is estimated repeated though it is not."""
    rows = [(i, " ".join(f"w{i}-{k}" for k in range(400)), "", "", 0) for i in range(200)]
    rows += [(900 + i, rows[i][1], "", "", 0) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "xxhash64(text) AS mark")
    found = {r["doc_id"]: len(r["anchors"]) for r in substrings.estimated_repeats(df).collect()}
    whole = min(found[i] for i in range(5))
    assert whole >= 10 and all(found[900 + i] == found[i] for i in range(5))
    assert sum(n for i, n in found.items() if 5 <= i < 900) < 0.05 * 195 * whole


def test_query_digest(spark, tmp_path):
    from helixframe.llm.registry import op10_substring_dedup

    spark.createDataFrame([(1, " a  b\n", "", "", 0), (2, None, "", "", 0)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["kept_sha256"] for r in op10_substring_dedup(spark, str(tmp_path)).collect()}
    assert found == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
