"""Derived views over the driver's tables.

The tables hold no DNA, so sequence views are derived with functions that Spark and DuckDB
share (hex ``md5`` digests translated to bases).  A view's SQL is one text for both engines;
``STR`` in it stands for the engine's text type.  Views name each other and the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DNA = "translate(md5({0}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _digest(*keys: str) -> str:
    return "concat(" + ", ".join(_DNA.format(k) for k in keys) + ")"


#: Fixed values of the fixtures: length of sequences and of external fragments, and of the derived genome.
LENGTH, FRAGMENT, GENOME = 50, 150, 3200

VIEWS = {
    # 50-base strings in families of five: two members of a family differ at two positions.
    "sequences": f"""
        SELECT p_partkey AS sample_index,
               concat(substr(b, 1, pos - 1), translate(substr(b, pos, 1), 'ACGT', 'CGTA'), substr(b, pos + 1)) AS sequence,
               p_retailprice AS strength
        FROM (SELECT p_partkey, p_retailprice, pos, substr({_digest("concat(cast(fam AS STR), 'a')", "concat(cast(fam AS STR), 'b')")}, 1, 50) AS b
              FROM (SELECT p_partkey, p_retailprice, cast(floor(p_partkey / 5.0) AS int) AS fam, cast((p_partkey % 5) * 7 + 1 AS int) AS pos FROM part) x) t""",
    # Families as clusters, dealt 14 : 3 : 3 over twenty places.
    "splits": """
        SELECT sample_index, cluster_id, CASE WHEN place < 14 THEN 'train' WHEN place < 17 THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT sample_index, cluster_id, (cluster_id * 7919) % 20 AS place FROM (SELECT sample_index, cast(floor(sample_index / 5.0) AS bigint) AS cluster_id FROM sequences) a) b""",
    "labelled": """
        SELECT s.sample_index, s.sequence, s.strength, round(log10(s.strength), 6) AS y, p.split, p.cluster_id
        FROM sequences s JOIN splits p ON s.sample_index = p.sample_index""",
    # Two scores with an error that depends on the index; score_b has many ties.
    "scores": """
        SELECT sample_index, y, split, cluster_id,
               round(y + ((sample_index * 37) % 101 - 50) / 100.0D, 6) AS score_a,
               round(floor((y + ((sample_index * 53) % 41 - 20) / 100.0D) * 10.0D) / 10.0D, 6) AS score_b,
               cast(sample_index % 3 AS int) AS fold
        FROM labelled""",
    "fam_ends": "SELECT sample_index, sequence FROM sequences WHERE sample_index % 5 = 0",
    # 150-base fragments; some hold a sequence at a shift, some its reverse complement, some with errors.
    "external": f"""
        SELECT s_suppkey AS ext_id, concat('tss_', cast(s_suppkey AS STR)) AS tss_name,
               CASE WHEN s_suppkey % 10 = 9 THEN 'control' ELSE 'tss' END AS category,
               CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
               cast((s_suppkey * 31) % {GENOME} AS int) AS tss_position,
               cast((s_suppkey * 31) % {GENOME} AS int) AS start_at,
               round(s_acctbal / 1000.0D, 6) AS expression,
               CASE WHEN s_suppkey % 4 = 0 THEN 'active' ELSE 'inactive' END AS activity,
               concat(substr(base, 1, 70 + shift), piece, substr(base, 70 + shift + 51)) AS variant
        FROM (SELECT s_suppkey, s_acctbal, cast(s_suppkey % 11 - 5 AS int) AS shift,
                     {_digest("concat(cast(s_suppkey AS STR), 'x')", "concat(cast(s_suppkey AS STR), 'y')", "concat(cast(s_suppkey AS STR), 'z')", "concat(cast(s_suppkey AS STR), 'u')", "concat(cast(s_suppkey AS STR), 'v')")} AS long_base,
                     substr({_digest("concat(cast(s_suppkey AS STR), 'x')", "concat(cast(s_suppkey AS STR), 'y')", "concat(cast(s_suppkey AS STR), 'z')", "concat(cast(s_suppkey AS STR), 'u')", "concat(cast(s_suppkey AS STR), 'v')")}, 1, 150) AS base,
                     CASE WHEN s_suppkey % 3 = 0 THEN q.sequence WHEN s_suppkey % 3 = 1 THEN reverse(translate(q.sequence, 'ACGT', 'TGCA'))
                          ELSE substr({_digest("concat(cast(s_suppkey AS STR), 'p')", "concat(cast(s_suppkey AS STR), 'q')")}, 1, 50) END AS piece
              FROM supplier JOIN sequences q ON q.sample_index = s_suppkey) t""",
    # The same fragments with one base dropped and one changed: for edit distances.
    "edited": """
        SELECT c_custkey AS edit_id, concat(substr(sequence, 1, 10), substr(sequence, 12, 20), translate(substr(sequence, 32, 1), 'ACGT', 'GTAC'), substr(sequence, 33)) AS text
        FROM customer JOIN sequences ON sample_index = c_custkey WHERE c_custkey % 3 = 0""",
    # A circular genome, cut in pieces of 32 bases; genome_text joins them.
    "genome_pieces": f"SELECT n_nationkey AS piece, {_digest("concat(n_name, 'a')", "concat(n_name, 'b')", "concat(n_name, 'c')", "concat(n_name, 'd')")} AS bases FROM nation",
    # Generated strings in buckets of generator, group and run.
    "generated": f"""
        SELECT generator, grp, run, sample_index, sequence, round(target + ((sample_index * 7 + run) % 97 - 48) / 100.0D, 6) AS score_m, round(target + ((sample_index * 11 + run) % 89 - 44) / 80.0D, 6) AS score_s, target
        FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'AR' ELSE 'VAE' END AS generator, CASE l_returnflag WHEN 'A' THEN 'weak' WHEN 'N' THEN 'medium' ELSE 'strong' END AS grp,
                     l_linenumber AS run, l_orderkey AS sample_index, CASE l_returnflag WHEN 'A' THEN 1.5D WHEN 'N' THEN 2.2D ELSE 2.9D END AS target,
                     substr({_digest("concat(cast(l_orderkey AS STR), '-', cast(l_linenumber AS STR))", "concat(cast(l_orderkey AS STR), '+', cast(l_linenumber AS STR))")}, 1, 50) AS sequence,
                     row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS again
              FROM lineitem WHERE l_linenumber <= 3) t WHERE again = 1""",
    # Fragments of modules, and counts by position, as a library workbook has them.
    "library": f"""
        SELECT c_custkey AS lib_id, {_digest("concat(cast(c_custkey AS STR), 'm')")} AS m1, substr({_digest("concat(cast(c_custkey % 50 AS STR), 'n')")}, 1, 20) AS m2,
               substr({_digest("concat(cast(c_custkey % 20 AS STR), 'o')")}, 1, 25) AS m3, CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS quality, round(c_acctbal, 6) AS amount FROM customer""",
    "tss_counts": """
        SELECT c_custkey AS lib_id, pos, CASE WHEN (c_custkey + pos) % 7 = 0 THEN NULL ELSE (c_custkey * pos * 13) % 17 END AS hits
        FROM customer CROSS JOIN (SELECT n_nationkey + 1 AS pos FROM nation WHERE n_nationkey < 6) p""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"(?:\bFROM|\bJOIN|,)\s+{v}\b(?!\s*[,.=<>])", sql) or re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", sql)]


def needed(sql: str) -> list[str]:
    """Views that a statement names, directly or through others, each after what it needs."""
    out: list[str] = []

    def visit(name: str) -> None:
        for inner in _names(VIEWS[name]):
            visit(inner)
        if name not in out:
            out.append(name)

    for name in _names(sql):
        visit(name)
    return out


def spark_text(sql: str) -> str:
    return re.sub(r"\bSTR\b", "string", sql)


def duck_text(sql: str) -> str:
    """DuckDB's form: its text type, and doubles without the suffix."""
    sql = re.sub(r"(?<![\w.])(\d+(?:\.\d+)?)D\b", r"cast(\1 AS double)", sql)
    return re.sub(r"\bSTR\b", "varchar", sql)


def oracle(sql: str) -> str:
    """A DuckDB statement with the views that it names in front."""
    ctes = [f"{v} AS ({VIEWS[v]})" for v in needed(sql)]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        body, ctes = body[len("WITH RECURSIVE") :], [*ctes, ""]
    elif body.upper().startswith("WITH"):
        body, ctes = body[len("WITH") :], [*ctes, ""]
    head = "WITH RECURSIVE " + ", ".join(ctes) if ctes else ""
    return duck_text(f"{head} {body}")


def view(spark: SparkSession, sf_dir: str, name: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """A derived view as a DataFrame; ``tables`` has frames of tables that are not to be read again."""
    tables = tables or {}
    sql, frames = VIEWS[name], {}
    for source in [*_names(sql), *(t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql))]:
        frames[source] = view(spark, sf_dir, source, tables) if source in VIEWS else tables.get(source) or table(spark, sf_dir, source)
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){source}\b", rf"\1\2{{{source}}}", sql)
    return spark.sql(spark_text(sql), **frames)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_index, sequence, strength)`` derived from ``part``."""
    return view(spark, sf_dir, "sequences")


def genome_text(spark: SparkSession, sf_dir: str) -> str:
    """The genome as one string: 25 pieces of 128 bases."""
    return "".join(r["bases"] for r in view(spark, sf_dir, "genome_pieces").orderBy("piece").collect())
