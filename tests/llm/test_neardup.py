import random

import numpy as np
import pytest

from helixframe.llm import neardup
from tests.llm.texts import SCHEMA, Union, corpus, documents, shingles


def brute(rows, size, percent=80):
    """Groups of documents ``(doc_id, text)`` and their sets; the root of a group is its smallest."""
    own, sets = Union(), {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            own.find((doc_id, text or ""))
            sets.setdefault((doc_id, text or ""), shingles(text, size))
    docs = sorted(sets)
    for x, i in enumerate(docs):
        for j in docs[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                own.join(i, j)
    return own, sets


def check(spark, rows, size):
    found = neardup.near_duplicates(documents(spark, rows), size)
    own, sets = brute(rows, size)
    wanted = [(i, len(sets[i, t or ""]), own.find((i, t or ""))[0], own.find((i, t or ""))[0] == i) for i, t, *_ in rows if i is not None]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(rows)
    assert sorted(r for r in got if r[0] is not None) == sorted(wanted)
    assert not any(r[3] for r in got if r[0] is None)


@pytest.mark.parametrize("size", [4, 5])
def test_matches_brute_force_on_odd_rows(spark, size):
    check(spark, corpus(), size)


def test_large_groups_of_near_copies_around_the_threshold(spark, monkeypatch):
    """A hub that all copies resemble, copies that resemble each other less, and blocks small enough to be used."""
    monkeypatch.setattr(neardup, "FEW", 6)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(120), rng.randint(0, 9)):
            words[k] = f"x{i}-{k}"
        rows.append((500 - i, " ".join(words), "en", "a", 1))
    rows += [(600 + i, " ".join(base[:60] + [f"y{i}-{k}" for k in range(60)]), "en", "a", 1) for i in range(30)]
    check(spark, rows, 4)


def test_rows_of_a_shared_id_have_their_own_links(spark):
    """(5, A), (5, B), (7, A and a word), (9, B and a word): 7 and 9 both link, each to its own row 5."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a, "en", "a", 1), (5, b, "en", "a", 1), (7, f"{a} more", "en", "a", 1), (9, f"{b} more", "en", "a", 1), (9, "alone here", "en", "a", 1), (5, b, "en", "a", 1)]
    for order in (rows, rows[::-1]):
        found = neardup.grouped(spark.createDataFrame(order, SCHEMA), 4).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == [(5, 57, 5)] * 3 + [(7, 58, 5), (9, 1, 9), (9, 58, 5)]
        assert len({r["component"] for r in found}) == 3


def test_unlike_documents_under_one_large_key(spark, monkeypatch):
    """Documents that share half their shingles meet under many keys; pairs above the threshold among them are all found."""
    monkeypatch.setattr(neardup, "FEW", 4)
    monkeypatch.setattr(neardup, "BLOCK", 6)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(40):
        own = [f"y{i}-{k}" for k in range(25)]
        rows.append((i, " ".join(base + own), "en", "a", 1))
        if i % 4 == 0:
            own[rng.randrange(25)] = "z"
            rows.append((1000 - i, " ".join(base + own), "en", "a", 1))
    check(spark, rows, 4)


def test_least_matches_bounds_the_chance_to_miss():
    rng = np.random.default_rng(0)
    n, hashes = 20_000, neardup.BANDS * neardup.BAND_ROWS
    left = np.zeros((n, hashes), dtype=np.uint16)
    same = rng.random((n, hashes)) < 0.8
    assert neardup.likely(left, np.where(same, 0, 1).astype(np.uint16), 0.8).mean() > 0.999
    apart = rng.random((n, hashes)) < 0.4
    assert neardup.likely(left, np.where(apart, 0, 1).astype(np.uint16), 0.8).mean() < 0.001


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(0, 2**63, size=k, dtype=np.uint64) for k in (800, 100, 100))
    x, y = neardup.signature(np.concatenate([shared, a])), neardup.signature(np.concatenate([shared, b]))
    assert abs((x == y).mean() - 0.8) < 0.1


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
