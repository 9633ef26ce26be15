"""The registered queries on the smallest tables: columns, and those with SQL against it."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "scripts"))

import __spark_entry__ as entry  # noqa: E402
from compare import rows  # noqa: E402

from tidemark.llm import catalog  # noqa: E402

DATA = Path(entry.DATA) / "sf0.001"
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
COLUMNS = {
    "p2_found": [("tbl", "string"), ("fld", "string"), ("case_id", "string"), ("kind", "string"), ("ord", "int")],
    "p3_found": [("tbl", "string"), ("key_a", "string"), ("key_b", "string")],
    "p6_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("shape", "string")],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_no_row_twice(spark, name):
    df = catalog.llm_queries()[name](spark, str(DATA))
    assert df.dtypes == COLUMNS[name]
    found = df.collect()
    assert found and len(set(map(tuple, found))) == len(found)


@pytest.mark.parametrize("name", sorted(catalog.llm_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = catalog.llm_queries()[name](spark, str(DATA))
    result = con.execute(catalog.llm_sql()[name])
    columns = [d[0] for d in result.description]
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_keys_of_pairs_are_in_order(spark):
    assert all(r.key_a < r.key_b for r in catalog.llm_queries()["p3_found"](spark, str(DATA)).collect())
