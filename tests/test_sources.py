"""Readers and writers."""

import io
import zipfile

import numpy as np
import pytest

from helixframe.operators.validate import GateError
from helixframe.sources import readers, sinks


def test_numpy_pair(spark, tmp_path):
    np.save(tmp_path / "s.npy", np.array(["acgt", "GGCC", "TTAA"]))
    np.save(tmp_path / "y.npy", np.array(["1.5", "2.5", "3.5"]))
    found = readers.read_numpy_pair(spark, str(tmp_path), "s.npy", "y.npy", 4).orderBy("sample_index").collect()
    assert [tuple(r) for r in found] == [(0, "ACGT", 1.5), (1, "GGCC", 2.5), (2, "TTAA", 3.5)]
    np.save(tmp_path / "short.npy", np.array([1.0]))
    with pytest.raises(Exception, match="not two equal"):
        readers.read_numpy_pair(spark, str(tmp_path), "s.npy", "short.npy", 4)
    with pytest.raises(GateError, match="5 bases"):
        readers.read_numpy_pair(spark, str(tmp_path), "s.npy", "y.npy", 5)


def test_delimited_text(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,x\nfoo,1\n".encode())
    assert [tuple(r) for r in readers.read_required_csv(spark, f"{tmp_path}/a.csv", ["name", "x"]).collect()] == [("foo", "1")]
    with pytest.raises(GateError, match="lacks the columns y"):
        readers.read_required_csv(spark, f"{tmp_path}/a.csv", ["y"])
    (tmp_path / "b.tsv").write_text(" k \t v \n a \t 1 \n")
    assert [r.asDict() for r in readers.read_padded_tsv(spark, f"{tmp_path}/b.tsv").collect()] == [{"k": "a", "v": "1"}]
    (tmp_path / "s.csv").write_text("sample_index,split,cluster_id\n1,train,0\n0,test,1\n")
    assert readers.read_split_csv(spark, f"{tmp_path}/s.csv").count() == 2
    (tmp_path / "bad.csv").write_text("sample_index,split,cluster_id\n1,train,0\n1,test,1\n")
    with pytest.raises(GateError):
        readers.read_split_csv(spark, f"{tmp_path}/bad.csv")
    (tmp_path / "l.txt").write_text("acgt\n\n ggcc \n")
    assert sorted(r[0] for r in readers.read_text_list(spark, f"{tmp_path}/l.txt", 4).collect()) == ["ACGT", "GGCC"]
    (tmp_path / "c.tsv").write_text("k\tcategory\n1\ttss\n2\tother\n")
    assert readers.read_category_tsv(spark, f"{tmp_path}/c.tsv", "category", "tss").count() == 1


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">one first\nACG\nTT\n>two\nggg\n")
    assert sorted(tuple(r) for r in readers.read_fasta(spark, f"{tmp_path}/g.fa", "one").collect()) == [("one first", "ACGTT"), ("two", "GGG")]
    with pytest.raises(GateError):
        readers.read_fasta(spark, f"{tmp_path}/g.fa", "three")


def test_workbook(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>ID</t></si><si><t>a</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c></row><row><c r="A3"><v>7</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.read_workbook(spark, f"{tmp_path}/w.xlsx", "ID").collect()] == [("a", "5"), ("7", None)]
    with pytest.raises(GateError):
        readers.read_workbook(spark, f"{tmp_path}/w.xlsx", "missing")


def test_configuration():
    text = '[project]\n[data]\nlabel_transform = "log10"\n[split]\ntrain_ratio = 0.7\nvalidation_ratio = 0.15\ntest_ratio = 0.15\n[features]\n[model]\n'
    assert readers.load_config(text)["data"]["label_transform"] == "log10"
    for bad in (text.replace("0.7", "0.8"), text.replace("log10", "ln"), text.replace("[model]", "")):
        with pytest.raises(ValueError):
            readers.load_config(bad)


def test_reports_and_archives():
    assert readers.parse_report(sinks.report_text({"b": 1.5, "a": [None]})) == {"a": [None], "b": 1.5}
    with pytest.raises(ValueError):
        sinks.report_text({"x": float("nan")})
    assert sinks.markdown_report("T", [("S", ["a", "b"], [(1, None)])]) == "# T\n\n## S\n\n| a | b |\n| --- | --- |\n| 1 |  |\n"
    files = {"b.txt": b"two", "a.txt": b"one"}
    data = sinks.deterministic_zip(files)
    assert data == sinks.deterministic_zip(dict(reversed(files.items())))
    sinks.verify_zip(data, sinks.manifest(files))
    with pytest.raises(ValueError, match="a.txt"):
        sinks.verify_zip(data, sinks.manifest(files | {"a.txt": b"other"}))
    assert zipfile.ZipFile(io.BytesIO(data)).namelist() == ["a.txt", "b.txt"]
    for chart in (sinks.bar_chart(["a"], [1.0]), sinks.line_chart([1.0, 2.0]), sinks.heat_map([[0.0, 1.0]])):
        assert chart.startswith("<svg") and chart.endswith("</svg>\n")


def test_logger_replaces_its_handlers(tmp_path):
    first = sinks.run_logger("helixframe-test", f"{tmp_path}/one")
    first.info("hello")
    log = sinks.run_logger("helixframe-test", f"{tmp_path}/two", "own.log", "warning")
    assert log is first and len(log.handlers) == 2 and not log.propagate
    log.info("silent")
    log.warning("grüße")
    sinks.close_logger(log)
    assert (tmp_path / "one" / "pipeline.log").read_text().count("\n") == 1
    assert (tmp_path / "two" / "own.log").read_text(encoding="utf-8").endswith("grüße\n")
