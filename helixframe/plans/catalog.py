"""The registered queries over the engine's own operators, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.fixtures import oracle

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("scalar_queries", "table_queries", "join_queries", "statistic_queries", "model_queries", "pipeline_queries")

#: Columns that Spark numbers with 32 bits (positions, codes, shifts) and SQL with 64: returned with 64.
LONGS = {
    "prj10_shifted_windows": ("shift",),
    "prj12_one_hot": ("cells", "ones"),
    "prj13_kmers": ("pos",),
    "prj14_position_code": ("pos", "code"),
    "prj15_spaced_pairs": ("code",),
    "agg03_histogram": ("bin",),
    "agg11_position_base_frequency": ("pos",),
    "agg12_position_kmer_frequency": ("pos",),
    "agg16_explained_variance": ("pos",),
    "agg21_profile_mean": ("pos",),
    "jon11_shifted_witness": ("shift",),
    "met10_js_positions": ("pos",),
    "gen01_position_table": ("pos",),
    "gen02_conditional_table": ("pos",),
    "gen03_markov_table": ("pos",),
    "gen04_continuous_table": ("pos",),
    "gen05_position_prior_table": ("pos",),
}

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle over the derived views, in the text both engines share."""

    def add(function: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        wide = LONGS.get(name, ())
        _queries[name] = (lambda spark, sf_dir: function(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in wide})) if wide else function
        if sql is not None:
            _oracles[name] = oracle(sql)
        return function

    return add


def _load() -> None:
    for module in MODULES:
        import_module(f"helixframe.plans.{module}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _queries["agg05_group_profile"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
