"""The numbered queries that have SQL, against DuckDB over whole tables."""

import duckdb
import pytest
from compare import digest

from tabloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[key](spark, SF).toPandas(), con.execute(ORACLES[key]).df()
    assert digest(got) == digest(want)


@pytest.mark.parametrize("key", ["op1_simhash", "op4_mixing", "op5_suffix_dedup"])
def test_query_over_the_whole_table(spark, key):
    """One row per document at least, none lost or made up."""
    ids = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    got = [r[0] for r in QUERIES[key](spark, SF).select("doc_id").collect()]
    assert set(got) == ids and (key == "op4_mixing" or len(got) == len(ids))
