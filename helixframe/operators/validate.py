"""Validation gates: checks that raise before a plan goes on.

Each gate is one aggregate over the data; the driver gets one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.bases import is_valid


class GateError(ValueError):
    """A gate that does not hold; the message carries counts and a first example."""


def check_sequences(df: DataFrame, length: int, sequence: str = "sequence", label: str = "strength") -> DataFrame:
    """Every string has the length and alphabet, every label is finite and positive, and there are rows."""
    bad_text = ~is_valid(F.col(sequence), length)
    bad_label = F.coalesce(F.isnan(label) | (F.col(label) <= 0) | (F.col(label) == float("inf")), F.lit(True))
    row = df.agg(
        F.count("*").alias("n"),
        F.count_if(bad_text).alias("text"),
        F.min(F.when(bad_text, F.col(sequence))).alias("first_text"),
        F.count_if(bad_label).alias("label"),
        F.min(F.when(bad_label, F.col(label))).alias("first_label"),
    ).first()
    if not row["n"]:
        raise GateError("there are no sequences")
    if row["text"]:
        raise GateError(f"{row['text']} strings are not {length} bases long, the first is {row['first_text']!r}")
    if row["label"]:
        raise GateError(f"{row['label']} labels are not positive and finite, the first is {row['first_label']!r}")
    return df


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """No row breaks the condition (null breaks it)."""
    n = df.where(~F.coalesce(condition, F.lit(False))).count()
    if n:
        raise GateError(f"{n} rows: {message}")
    return df


def bijection(df: DataFrame, index: str, by: list[str] | None = None) -> DataFrame:
    """Per group whether an index runs over 0 to n - 1, each once."""
    c = F.col(index)
    aggs = [
        F.count("*").alias("n"),
        F.count_distinct(c).alias("n_distinct"),
        F.min(c).cast("long").alias("lowest"),
        F.max(c).cast("long").alias("highest"),
    ]
    out = df.groupBy(*(by or [])).agg(*aggs)
    return out.withColumn("dense", (F.col("n") == F.col("n_distinct")) & (F.col("lowest") == 0) & (F.col("highest") == F.col("n") - 1))


def check_bijection(df: DataFrame, index: str, by: list[str] | None = None) -> DataFrame:
    if not bijection(df, index, by).where("NOT dense").isEmpty():
        raise GateError(f"{index} does not run from 0 to n - 1")
    return df


def spanning_groups(df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups that lie in more than one part: the leakage gate wants none."""
    return df.groupBy(group).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def conflicting_labels(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label."""
    return df.groupBy(key).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("n")).where("labels > 1")


def check_digest(found: str, recorded: str, name: str) -> None:
    """Provenance gate: an input's digest equals the recorded one."""
    if found != recorded:
        raise GateError(f"{name} has digest {found}, recorded is {recorded}")


def check_reproduced(new: float, old: float, tolerance: float, name: str) -> None:
    """Metric gate: a recomputed figure is within the tolerance of the recorded one."""
    if not abs(new - old) <= tolerance:
        raise GateError(f"{name}: {new} differs from {old} by more than {tolerance}")


def check_conclusion(holds: bool, statement: str) -> None:
    """Conclusion gate: an ordering or sign that a report states still holds."""
    if not holds:
        raise GateError(f"no longer true: {statement}")
