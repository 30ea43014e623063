import duckdb

import __spark_entry__ as E
from quadrant.plans import catalog, oracles

FAST = ["x1_clean_text", "r1_reply_extract", "p1_prepare_prompts", "r10_parse_matrices", "j6_lint", "d5_execute_e2",
        "w2_entropy_ratio", "r6_answer_reward", "p9_chat_text", "p11_normalize"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "reward" in df.columns


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracles.oracles())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_fast_queries_match_oracle_small(spark):
    import sys
    sys.path.insert(0, E.__file__.rsplit("/", 1)[0] + "/tools")
    from compare import TABLES, digest
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in FAST:
        df = E.queries()[name](spark, sf)
        rel = con.sql(E.oracle_sql()[name])
        h1, _ = digest(df.columns, [tuple(r) for r in df.collect()])
        h2, _ = digest(rel.columns, rel.fetchall())
        assert h1 == h2, name
