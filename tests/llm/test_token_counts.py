import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixframe.llm import token_counts as T
from helixframe.llm.common import scratch_path
from helixframe.llm.tokens import WordCounts
from tests.llm.texts import SCHEMA, corpus, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return WordCounts(PATH, most=2000)


def wanted(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=120), st.text("abcXYZ.,'! \n\tÉé́​\x1c\x85<|startofx>", max_size=80), st.lists(st.sampled_from(["don't", "<|endoftext|>", "I'LL", "x<|startoftext|>y", "...", "a.b,c", "ÀÉ", "ﬁ", "İ"]), max_size=12).map(" ".join)))
def test_counts_add_up_over_words(library, counter, text):
    assert counter([text]) == [wanted(library, text)]


def test_cold_and_warm_cache(spark, library):
    rows = corpus()
    path = scratch_path(spark, "cache")
    for turn in range(2):
        found = T.token_counts(documents(spark, rows), PATH, path).collect()
        assert len(found) == len(rows)
        pairs = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in found)
        assert pairs == sorted((str(i), len((t or "").encode()), wanted(library, t)) for i, t, *_ in rows)
        stored = spark.read.parquet(path)
        distinct = len({" ".join((t or "").split()) for _, t, *_ in rows})
        assert stored.select("digest").distinct().count() == stored.count() == distinct
        if turn:
            assert stored.count() == before
        before = stored.count()
    more = [*rows, (5000, "brand new text", "en", "a", 1)]
    T.token_counts(documents(spark, more), PATH, path).collect()
    assert spark.read.parquet(path).count() == before + 1


def test_repeated_rows_are_encoded_once(spark):
    path = scratch_path(spark, "cache")
    rows = [(1, "one text", "en", "a", 1)] * 50 + [(2, " one   text", "en", "a", 1)]
    assert T.token_counts(spark.createDataFrame(rows, SCHEMA), PATH, path).count() == 51
    assert spark.read.parquet(path).count() == 1


def test_other_versions_are_misses(spark):
    path = scratch_path(spark, "cache")
    spark.sql("SELECT unhex('00') AS digest, 'other' AS version, 5L AS n_tokens").write.parquet(path)
    assert T.stored_counts(spark, path, "mine").count() == 0


def test_ids_shared_by_different_texts(spark, library):
    rows = [(1, "alpha beta", "", "", 0), (1, "gamma delta epsilon zeta", "", "", 0), (None, "eta", "", "", 0), (None, "theta iota", "", "", 0)]
    found = T.token_counts(spark.createDataFrame(rows, SCHEMA), PATH, scratch_path(spark, "cache")).collect()
    assert sorted(r["n_tokens"] for r in found) == sorted(wanted(library, r[1]) for r in rows)


def test_empty_table(spark):
    assert T.token_counts(spark.createDataFrame([], SCHEMA), PATH, scratch_path(spark, "cache")).count() == 0
