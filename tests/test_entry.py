import duckdb
import pytest

import __spark_entry__

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    import numpy as np
    import pandas as pd

    def plain(x):
        if x is None or x is pd.NA or isinstance(x, float) and x != x:
            return None
        if isinstance(x, (float, np.floating)):
            return round(float(x), 9)
        return str(x)

    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", ["capture_eligibility", "snapshot_manifest", "bm25_filtered", "ast_aware_search", "export_closure", "scope_resolve", "definition_at", "graph_neighbors", "citation_status", "report_validation", "published_snapshots", "statement_windows", "sentence_windows", "graph_node_list", "evidence_of_queries", "query_errors", "symbol_postings", "symbol_bm25", "labels_hash", "label_gates", "module_config", "symbols_of_files", "definitions_by_id", "listed_sources", "snapshot_history", "strategy_summary", "exported_report", "names_of_files", "script_modules", "embedding_components"])
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, ROOT).toPandas()
    want = db.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [len(got), *rows(got)] == [len(want), *rows(want)]


def test_every_oracle_has_its_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
