import random
import zlib

import numpy as np

from helixframe.llm import toxicity as T
from tests.llm.texts import SCHEMA, corpus, documents


def labelled(seed=1, size=500):
    rng = random.Random(seed)
    words = ["river", "stone", "window", "garden", "letter", "music", "yellow", "market", "silver", "forest"]
    bad = ["grobian", "flegelei"]
    docs, labels = [], []
    for i in range(size):
        toxic = int(i % 4 == 0)
        text = [rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(5, 200))]
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", "en", "er"]))
        docs.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_split(spark):
    docs, labels = labelled()
    docs += [(9000, None, None, None, 0), (9001, "", "en", "a", 0), (None, "river", "en", "a", 1), (9002, "grobian", "en", "a", 1)]
    frame = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    found = T.toxicity(documents(spark, docs), frame).collect()
    assert len(found) == len(docs)
    truth = {i: t for i, _, t in labels}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    by = {r["doc_id"]: r for r in found}
    assert by[9000]["score"] == by[9001]["score"] < 0.5 < by[9002]["score"]


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = labelled(size=300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    frame = spark.createDataFrame(docs, SCHEMA)
    a = {r["doc_id"]: r["score"] for r in T.toxicity(frame, spark.createDataFrame(labels, schema)).collect()}
    b = {r["doc_id"]: r["score"] for r in T.toxicity(frame, spark.createDataFrame(flipped, schema)).collect()}
    assert a == b


def test_the_bound_on_training_rows(spark):
    docs, labels = labelled(size=300)
    frame = spark.createDataFrame(docs, SCHEMA)
    found = T.toxicity(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), most=100).collect()
    assert len(found) == 300


def test_without_labels_of_both_kinds_nothing_is_toxic(spark):
    for labels in ([], [(0, 1), (3, 1)], [(0, 0)]):
        found = T.toxicity(documents(spark, corpus()), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert {r["score"] for r in found} == {0.0} and {r["predicted"] for r in found} == {0} and len(found) == len(corpus())


def test_labels_without_documents_change_nothing(spark):
    docs, labels = labelled(size=200)
    schema = "doc_id long, quality int, toxic int"
    frame = spark.createDataFrame(docs, SCHEMA)
    a = {r["doc_id"]: r["score"] for r in T.toxicity(frame, spark.createDataFrame(labels, schema), most=150).collect()}
    absent = labels + [(10_000 + i, 1, i % 2) for i in range(5000)]
    b = {r["doc_id"]: r["score"] for r in T.toxicity(frame, spark.createDataFrame(absent, schema), most=150).collect()}
    assert a == b and min(a.values()) < 0.5 < max(a.values())


def test_rows_of_a_shared_id_are_scored_by_their_own_text(spark):
    docs, labels = labelled(size=300)
    docs += [(9000, "grobian flegelei", "en", "a", 1), (9000, "river stone", "en", "a", 1)]
    found = T.toxicity(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(r["predicted"] for r in found if r["doc_id"] == 9000) == [0, 1]


def test_scores_against_a_brute_force_fit(spark):
    """Presence counts, ratios, G and the regression with plain dictionaries and a dense matrix."""
    docs, labels = labelled(size=120)
    truth = {i: t for i, _, t in labels}
    sets = {i: set(T.grams(text).tolist()) for i, text, *_ in docs}
    train = [i for i, *_ in docs if zlib.crc32(str(i).encode()) % 5]
    size = [sum(truth[i] == k for i in train) for k in (0, 1)]
    count = {b: [sum(truth[i] == k and b in sets[i] for i in train) for k in (0, 1)] for b in set().union(*(sets[i] for i in train))}

    def g(row):
        out, share = 0.0, sum(row) / sum(size)
        for x, n in zip(row, size, strict=True):
            for seen, part in ((x, share), (n - x, max(1e-12, 1 - share))):
                out += 2 * seen * np.log(seen / (n * part)) if seen else 0.0
        return out

    used = sorted(b for b, row in count.items() if g(row) >= T.SIGNIFICANT)
    ratio = np.array([np.log((count[b][1] + 0.5) / (size[1] + 1)) - np.log((count[b][0] + 0.5) / (size[0] + 1)) for b in used])
    x = np.array([[b in sets[i] for b in used] for i in train]) * ratio
    y = np.array([truth[i] for i in train], dtype=float)
    z1 = np.column_stack([x, np.ones(len(y))])
    at = np.zeros(len(used) + 1)
    for _ in range(50):  # Newton's method, with the full Hessian
        p = 1 / (1 + np.exp(-(z1 @ at)))
        ridge = T.RIDGE * np.append(np.ones(len(used)), 0.0)
        at = at - np.linalg.solve(z1.T @ (z1 * (p * (1 - p))[:, None]) / len(y) + np.diag(ridge), z1.T @ (p - y) / len(y) + ridge * at)
    w, bias = at[:-1], at[-1]
    found = T.toxicity(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for r in found:
        z = bias + sum(w[k] * ratio[k] for k, b in enumerate(used) if b in sets[r["doc_id"]])
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-3
    assert len(used) > 5


def test_ratios_and_grams():
    assert T.log_count_ratios(np.array([10]), np.array([10]), 100, 100)[0] == 0
    assert len(T.grams("")) == 0 and len(T.grams("abc")) == 2 + 1
    assert (T.grams("Ab  c") == T.grams("ab c")).all()


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert T.toxicity(spark.createDataFrame([], SCHEMA), labels).count() == 0
