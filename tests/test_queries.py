"""Spark queries against DuckDB SQL on the same tables, as the driver holds them."""

from pathlib import Path

import duckdb
import pytest

from palimpsest.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = """r01_aadhaar_number r02_pan_number r08_phone_number r09_email_address r16_pin_code r17_pin_code c01_c02_context_scores c05_c10_elected_entities
    n12_scrub v00_verhoeff v05_luhn t01_text_tables c19_entities_to_pages p01_policy_balanced x03_typed_placeholders x04_pseudonyms
    a04_session_metrics a09_document_classes q06_page z01_in_window z08_sessions e07_measures_by_type""".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(registry.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(found.description)}
    assert sorted(at) == cols
    want = sorted(repr([plain(r[at[c]]) for c in cols]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
