import duckdb
import pytest

import __spark_entry__ as entry
from docquarry.plans import relational, search

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(search.SQL)[:6] + ["section_paths", "route_json", "column_gaps", "citation_sources"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    rows = lambda x: sorted(map(str, x[sorted(got.columns)].astype(object).where(x[sorted(got.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_flagship_and_registry(spark):
    # sf0.001 holds vectors without a document; their payload is null.
    assert entry.entry(spark).count() == 20
    assert set(relational.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
