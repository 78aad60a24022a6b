import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixframe.llm import packing
from helixframe.llm.common import materialize
from helixframe.llm.tokens import PROVEN, BpeIds
from tests.llm.texts import SCHEMA, corpus, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return BpeIds(PATH), Tokenizer.from_file(PATH)


@given(st.integers(0, 10_000), st.sampled_from([1, 2, 64, 2048]))
def test_binary_lengths(n, longest):
    found = packing.binary_lengths(n, longest)
    assert sum(found) == n and all(x & (x - 1) == 0 and x <= longest for x in found)
    assert found == sorted(found, reverse=True) and len([x for x in found if x < longest]) == len({x for x in found if x < longest})


def test_libraries_agree_on_every_proven_code_point(both):
    own, library = both
    texts = [f"a{c}b {c}{c} 1{c}2 .{c}, \n{c} {c}  {c}\t\n x'{c}" for c in map(chr, range(PROVEN)) if not "\ud800" <= c <= "\udfff"]
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own(text).tolist() == wanted.ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_libraries_agree_on_any_text(both, text):
    own, library = both
    assert own(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" + " " * 2_000_000 + "b", "a" + "\n" * 2_000_000, "\t" * 120_000 + "b  c", "x" * 2_000_000, "!?" * 200_000])
def test_very_long_runs_do_not_break_the_tokenizer(both, text):
    assert both[0](text).tolist() == both[1].encode(text, add_special_tokens=False).ids


def test_special_strings_are_special(both):
    assert both[0]("a <|endoftext|> b").tolist() == both[1].encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_round_trip(spark, both):
    rows = corpus()
    pieces = packing.number_sequences(materialize(packing.decompose(documents(spark, rows), PATH, 64), "test"), per_block=20).collect()
    by = {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
    for doc_id, text, *_ in rows:
        if [r[0] for r in rows].count(doc_id) > 1:
            continue
        ids = np.array([*both[1].encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted(by[doc_id], key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in own) == ids.tobytes()
        assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
        assert all(p["doc_tokens"] == len(ids) and p["offset"] == 0 for p in own)
    assert sorted(p["sequence_id"] for p in pieces) == list(range(len(pieces)))
    by_number = sorted(pieces, key=lambda p: p["sequence_id"])
    assert [p["length"] for p in by_number] == sorted((p["length"] for p in pieces), reverse=True)


def test_query_digests(spark, tmp_path):
    from helixframe.llm.registry import op4_binary_packing

    spark.createDataFrame([(1, "hello world", "en", "a", 1), (2, None, "en", "a", 1)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["doc_id"], r["start"]): r for r in op4_binary_packing(spark, str(tmp_path)).collect()}
    assert found[2, 0]["ids_crc32"] == zlib.crc32(np.array([1], dtype="<u4").tobytes()) and found[2, 0]["doc_tokens"] == 1


def test_empty_table(spark):
    assert packing.decompose(spark.createDataFrame([], SCHEMA), PATH).count() == 0
