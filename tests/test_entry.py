"""The registered queries of the library against their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

TABLES = Path("/root/testdata/sf0.001")
CHECKED = ("v01_similarity", "v04_topk_batch", "j01_tenant_search", "e08_macro_average", "g03_merge_entities", "g15_local_query", "a20_gram_fingerprints", "m04_instructions", "t01_percentiles", "p09_judged_subset", "io03_read_qrels", "s02_upsert_texts")


def values(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if x is None or x != x else str(float(x)) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x) for x in row) for row in df.itertuples(index=False))


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    import duckdb

    from lodestone import plans

    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    assert values(plans.queries()[name](spark, str(TABLES)).toPandas()) == values(con.sql(plans.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
