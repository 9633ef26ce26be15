"""The driver's contract: names, columns, and queries against their SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))

import __spark_entry__ as entry  # noqa: E402
from compare import rows  # noqa: E402

from tidemark.plans import catalog  # noqa: E402

DATA = Path(entry.DATA) / "sf0.001"
CHECKED = [
    "p1_found", "p1_schema", "p1_messages", "p5_found", "p5_totals", "spend_report_feature_env", "spend_report_once", "spend_under_cap", "spend_running", "detect_counts", "detect_redacted", "detect_guard",
    "redaction_scrubbed", "gate_evaluate", "gate_lengths", "gate_schema", "vector_topics", "content_kinds", "log_compressed", "pack_history", "pack_first_fit", "pack_orders", "ledger_links", "ledger_hashes",
    "replay_hashes", "replay_matched", "ingest_usage", "ingest_texts", "ingest_roots", "ingest_agents", "stream_windows",
]

needs_data = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, duck, name):
    df = catalog.core_queries()[name](spark, str(DATA))
    result = duck.execute(catalog.core_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["key_kind", "key_value"] and df.count() > 0
