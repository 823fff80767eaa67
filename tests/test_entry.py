import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PICK = ["a1_latest_chunks", "b3_register", "d6_postings", "h2_token_counts", "h17_contains_words", "j9_furniture", "k4_text_coverage", "l1_bm25", "l2_hybrid_search", "l3_session_search", "m2_scoped_lookup", "a13_listing_changes", "a20_offline_search", "c4_session_scope", "e7_sections", "e11_pieces", "j2_document_types", "n1_plan_failures", "p1_check_citations", "n1_waves", "s1_debounce"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", PICK)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    norm = lambda x: round(x, 5) + 0.0 if isinstance(x, float) else x
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in res.fetchall()), key=repr)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
