"""Training-data queries against their SQL in DuckDB."""

import duckdb
import pytest

from ledgerloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_lexical_search"])
def test_query_matches_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours = QUERIES[name](spark, sf_dir)
    theirs = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(tuple, ours.select(*names).collect()), key=str) == sorted(theirs.fetchall(), key=str)
