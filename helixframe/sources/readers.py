"""Readers with explicit schemas: arrays, CSV and TSV variants, FASTA, workbooks, text lists, configuration and reports."""

from __future__ import annotations

import io
import json
import re
import tomllib
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixframe.functions.bases import is_valid, normalise
from helixframe.operators.validate import GateError, check_bijection, check_sequences, require

# --------------------------------------------------------------------------- NumPy arrays


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__(start)
        self.start, self.stop = start, stop


class _PairReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        folder = Path(self.options["path"])
        texts, labels = (np.load(folder / self.options[k], mmap_mode="r", allow_pickle=False) for k in ("sequences", "labels"))
        if texts.ndim != 1 or labels.ndim != 1 or len(texts) != len(labels) or not len(texts):
            raise GateError(f"arrays of shapes {texts.shape} and {labels.shape} are not two equal, filled columns")
        return texts, labels

    def partitions(self):
        n = len(self._arrays()[0])
        size = max(1, int(self.options.get("rows", 100_000)))
        return [_Range(i, min(n, i + size)) for i in range(0, n, size)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        texts, labels = self._arrays()
        at = slice(partition.start, partition.stop)
        columns = [np.arange(partition.start, partition.stop), np.char.upper(texts[at].astype(str)), labels[at].astype(np.float64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sample_index", "sequence", "strength"])


class NumpyPairSource(DataSource):
    """``format("numpy_pair")``: two aligned ``.npy`` columns, memory-mapped and read by ranges of rows; the index becomes a column."""

    @classmethod
    def name(cls) -> str:
        return "numpy_pair"

    def schema(self) -> str:
        return "sample_index long, sequence string, strength double"

    def reader(self, schema) -> DataSourceReader:
        return _PairReader(self.options)


def read_numpy_pair(spark: SparkSession, folder: str, sequences: str, labels: str, length: int) -> DataFrame:
    """Validated ``(sample_index, sequence, strength)``; raises with a count and a first example of what is wrong."""
    from helixframe.shipping import ship

    ship(spark)
    spark.dataSource.register(NumpyPairSource)
    rows = spark.read.format("numpy_pair").options(path=folder, sequences=sequences, labels=labels).load()
    return check_sequences(rows, length)


# --------------------------------------------------------------------------- delimited text


def read_required_csv(spark: SparkSession, path: str, fields: list[str], sep: str = ",") -> DataFrame:
    """CSV with a header that must hold the fields; a byte order mark before it is dropped and every field stays text."""
    rows = spark.read.csv(path, header=True, sep=sep, inferSchema=False)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    missing = [f for f in fields if f not in rows.columns]
    if missing:
        raise GateError(f"{path} lacks the columns {', '.join(missing)}")
    return rows.select(*fields)


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_index, split, cluster_id)``: a bijection onto 0 to n - 1 with known split names."""
    rows = spark.read.schema("sample_index long, split string, cluster_id long").csv(path, header=True)
    check_bijection(rows, "sample_index")
    return require(rows, F.col("split").isin("train", "validation", "test"), "unknown split")


def read_padded_tsv(spark: SparkSession, path: str) -> DataFrame:
    """TSV whose cells and header are padded with blanks."""
    rows = spark.read.csv(path, header=True, sep="\t", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.toDF(*(c.strip() for c in rows.columns))


def read_category_tsv(spark: SparkSession, path: str, column: str, value: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep="\t").where(F.col(column) == value)


def read_species(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files one folder down, with the folder's name as ``species``."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder, header=True)
    return rows.withColumn("species", F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1))


def read_text_list(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """One string a line, upper-cased; blank lines are left out, others must hold bases only."""
    rows = spark.read.text(path).select(normalise(F.col("value")).alias("sequence")).where("sequence <> ''")
    return require(rows, is_valid(F.col("sequence"), length), "not a string of bases")


def read_fasta(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """``(name, sequence)`` of every record; ``header`` must begin the first name where it is given.

    Files are split at the record marks, so a record, not a file, must fit in a row.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) <> ''")
    parts = F.split("value", "\r?\n", 2)
    rows = records.select(F.trim(parts[0]).alias("name"), F.upper(F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"\s+", "")).alias("sequence"))
    if header is not None and rows.where(F.col("name").startswith(header)).isEmpty():
        raise GateError(f"{path} has no record that begins with {header}")
    return rows


# --------------------------------------------------------------------------- workbooks


def _sheet_rows(data: bytes, sheet: int) -> list[list[str | None]]:
    """Cells of a worksheet as text, read with the standard library: the format is zipped XML."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        out = []
        for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{space}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{space}c"):
                place = 0
                for letter in re.match(r"[A-Z]+", c.get("r", "A1")).group():
                    place = place * 26 + ord(letter) - 64
                value = c.find(f"{space}v")
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{space}t"))
                elif value is None or value.text is None:
                    text = None
                else:
                    text = shared[int(value.text)] if c.get("t") == "s" else value.text
                cells[place - 1] = text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def read_workbook(spark: SparkSession, path: str, key: str, sheet: int = 1) -> DataFrame:
    """A worksheet with a header row as text columns; ``key`` must be there and unique.  Workbooks are small by format."""
    data = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    header, *body = _sheet_rows(bytes(data), sheet)
    if key not in header:
        raise GateError(f"{path} lacks the column {key}")
    rows = [tuple([*r, *[None] * (len(header) - len(r))][: len(header)]) for r in body if any(v is not None for v in r)]
    df = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header))
    if df.groupBy(key).count().where("count > 1").isEmpty():
        return df
    raise GateError(f"{path} repeats values of {key}")


# --------------------------------------------------------------------------- configuration and reports


@dataclass(frozen=True)
class Config:
    """Sections of a run's configuration file."""

    sections: dict

    def __getitem__(self, name: str) -> dict:
        return self.sections[name]


def load_config(text: str, required: tuple[str, ...] = ("project", "data", "split", "features", "model")) -> Config:
    """Parse TOML; the required sections must be there, split ratios must sum to 1 and labels be log10."""
    sections = tomllib.loads(text)
    missing = [s for s in required if s not in sections]
    if missing:
        raise ValueError(f"missing sections: {', '.join(missing)}")
    ratios = [v for k, v in sections.get("split", {}).items() if k.endswith("_ratio")]
    if ratios and abs(sum(ratios) - 1) > 1e-9:
        raise ValueError(f"split ratios sum to {sum(ratios)}")
    if sections.get("data", {}).get("label_transform", "log10") != "log10":
        raise ValueError("only log10 labels are supported")
    return Config(sections)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A JSON result document as one row."""
    return spark.read.json(path, multiLine=True)


def parse_report(text: str) -> dict:
    return json.loads(text)
