"""Every registered query of the engine's own operators against its DuckDB oracle."""

import glob
import os

import duckdb
import pytest

from helixframe.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return f"{value + 0.0:.9g}"
    return [_plain(v) for v in value] if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = sorted(repr([_plain(r[c]) for c in names]) for r in df.collect())
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    assert dict(df.dtypes) == {c[0]: kinds[str(c[1])] for c in result.description}
    wanted = sorted(repr([_plain(r[columns.index(c)]) for c in names]) for r in result.fetchall())
    assert found == wanted


@pytest.mark.parametrize("name", ["grf06_nested_folds", "grf08_stratified_holdout", "gen01_position_sample", "gen03_markov_sample", "gen04_continuous_sample", "mdl12_extra_trees", "mdl13_histogram_boosting", "mdl17_out_of_fold", "mdl19_filter_mining", "pip19_shortlist"])
def test_queries_without_oracle_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
