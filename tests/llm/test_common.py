import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from helixframe.llm import common
from tests.llm.texts import Union


@given(st.lists(st.binary(min_size=1, max_size=4).filter(lambda b: not set(b) & set(b" \t\n\x0b\x0c\r")), min_size=1, max_size=40), st.integers(1, 12))
def test_rolling_depends_on_the_run_alone(words, length):
    hasher = common.WordHasher()
    at = hasher.ids(words)
    values = hasher.low[at]
    found = common.rolling(values, length, 0x9E3779B97F4A7C15)
    assert len(found) == max(0, len(words) - length + 1)
    seen = {}
    for i, h in enumerate(found.tolist()):
        assert seen.setdefault(tuple(words[i : i + length]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_hasher_starts_anew_when_full():
    hasher = common.WordHasher(most=10)
    for i in range(30):
        words = [f"{i}-{j}".encode() for j in range(8)] + [b"x", b"x"]
        at = hasher.ids(words)
        assert at[-1] == at[-2] and len(set(at.tolist())) == 9
        low = hasher.low[at]
    again = common.WordHasher()
    assert (again.low[again.ids(words)] == low).all()


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 200)] + [(5000, i) for i in range(300, 360)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (None, 3)]
    own = Union()
    for a, b in edges:
        if a is not None and b is not None:
            own.join(a, b)
    found = {r["id"]: r["component_id"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: own.find(x) for x in list(own.root)}


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixed_spreads_bits():
    x = common.mixed(np.arange(1000, dtype=np.uint64))
    assert len(np.unique(x >> np.uint64(48))) > 900
