from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_substrings import brute as brute_repeats
from tests.llm.test_neardup import brute as brute_copies
from tests.llm.test_toxicity import labelled
from tests.llm.texts import SCHEMA, corpus, documents


def _fixture(spark, path, rows, bad=("bad",)):
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    marks = sorted({(r[0], 1, int(any(b in (r[1] or "") for b in bad))) for r in rows if r[0] is not None})
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def _rows(df):
    return [tuple(r) for r in df.select(*P.COLUMNS).collect()]


def _key(r):
    return str(r[:3])


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    _fixture(spark, str(tmp_path), rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    clean = _rows(P.drop_toxic(spark, docs, str(tmp_path)))
    assert sorted(clean, key=_key) == sorted(rows, key=_key)  # no label is toxic, so nothing goes

    after = _rows(P.drop_near_duplicates(spark, docs, str(tmp_path)))
    own, sets = brute_copies(rows, 5)
    wanted, seen = [], set()
    for r in rows:
        node = (r[0], r[1] or "")
        if r[0] is None or not sets[node]:
            wanted.append(r)
        elif node not in seen and _least(own, sets, node, r[0]):
            wanted.append(r)
            seen.add(node)
    assert sorted(after, key=_key) == sorted(wanted, key=_key)

    frame = spark.createDataFrame(after, SCHEMA)
    cut = _rows(P.cut_repeats(spark, frame, str(tmp_path)))
    expected = []
    for row, (_, _, removed, kept) in zip(after, brute_repeats(after, 50), strict=True):
        if removed and kept:
            expected.append((row[0], kept, *row[2:4], len(kept)))
        elif not removed:
            expected.append(row)
    assert sorted(cut, key=_key) == sorted(expected, key=_key)

    mixed = P.mix_sources(spark, spark.createDataFrame(cut, SCHEMA), str(tmp_path))
    assert mixed.columns == list(P.COLUMNS)
    texts = _rows(mixed)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in texts)
    pieces = P.pack(spark, spark.createDataFrame(texts, SCHEMA), str(tmp_path)).collect()
    assert sum(p["length"] for p in pieces) == total
    assert sorted(p["sequence_id"] for p in pieces) == list(range(len(pieces)))


def _least(own, sets, node, doc_id):
    """Whether this row may stay for its group: it has the smallest id there (of two rows with that id either may)."""
    return own.find(node)[0] == doc_id and sum(n[0] == doc_id for n in sets if own.find(n) == own.find(node)) == 1


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    docs, labels = labelled(size=300)
    docs += [(9000, "grobian flegelei", "en", "a", 1), (9000, "river stone", "en", "a", 1), (None, "flegelei grobian", "en", "a", 1), (9001, None, "en", "a", 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = _rows(P.drop_toxic(spark, spark.createDataFrame(docs, SCHEMA), str(tmp_path)))
    toxic = {i for i, _, t in labels if t}
    assert sum(r[0] in toxic for r in left) <= 0.02 * len(toxic)
    assert sum(r[0] is not None and r[0] < 9000 and r[0] not in toxic for r in left) >= 0.98 * (300 - len(toxic))
    assert sorted(str(r[:2]) for r in left if r[0] is None or r[0] >= 9000) == ["(9000, 'river stone')", "(9001, None)"]


def test_sequences_read_back_in_training_order(spark, tmp_path):
    """The written rows of the mix, file by file, are the copies that the pieces give back, each whole and in order."""
    rows = [(i, " ".join(f"t{i}-{k}" for k in range(5 + i)), "en", "c" if i % 5 == 0 else "a", 1) for i in range(40)]
    P.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "").repartitionByRange(3, "n_chars").write.parquet(f"{tmp_path}/plain")
    P.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "").write.parquet(f"{tmp_path}/mixed")
    for name in ("plain", "mixed"):
        files = sorted(Path(f"{tmp_path}/{name}").glob("part-*.parquet"))
        wanted = [(r["doc_id"], r["text"]) for f in files for r in pq.read_table(f).to_pylist()]
        pieces = P.pack(spark, spark.read.parquet(f"{tmp_path}/{name}"), "").collect()
        copies = {}
        for p in sorted(pieces, key=lambda p: (p["file_no"], p["row_no"], p["start"])):
            copies.setdefault((p["file_no"], p["row_no"], p["doc_id"]), []).append(p)
        tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        found = []
        for (_, _, doc_id), own in copies.items():
            ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in own), dtype="<u4")
            assert len(ids) == own[0]["doc_tokens"] and ids[-1] == 1
            found.append((doc_id, tokenizer.decode(ids[:-1].tolist())))
        assert found == wanted and len(found) > len(set(found))  # some documents are taken more than once
        by_length = {}
        for p in sorted(pieces, key=lambda p: p["sequence_id"]):
            by_length.setdefault(p["length"], []).append((p["file_no"], p["row_no"], p["start"]))
        assert all(v == sorted(v) for v in by_length.values())
    positions = [i for i, _ in found]
    assert positions != sorted(positions)


def test_run_and_stage_list(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "mixing", "packing"]
    _fixture(spark, str(tmp_path), corpus(3, 30))
    found = P.run(spark, str(tmp_path)).collect()
    assert found and np.all([p["length"] & (p["length"] - 1) == 0 for p in found])


def test_empty_corpus(spark, tmp_path):
    _fixture(spark, str(tmp_path), [])
    assert P.run(spark, str(tmp_path)).count() == 0
