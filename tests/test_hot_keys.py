"""Queries on tables in which one order, supplier, part, customer, user, text and conversation holds a third of the rows."""

import shutil
from pathlib import Path

import pytest

SOURCE = Path("/root/testdata/sf0.001")
HOT = {
    "lineitem": "* REPLACE (CASE WHEN l_linenumber < 4 THEN 7 ELSE l_orderkey END AS l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN 5 ELSE l_suppkey END AS l_suppkey, "
                "CASE WHEN l_partkey % 5 < 2 THEN 11 ELSE l_partkey END AS l_partkey)",
    "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE o_custkey END AS o_custkey)",
    "events": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id)",
    "documents": f"* REPLACE (CASE WHEN doc_id % 3 = 0 THEN (SELECT text FROM '{SOURCE}/documents.parquet' WHERE doc_id = 5) ELSE text END AS text)",
    "conversations": "* REPLACE (CASE WHEN conv_id % 3 = 0 THEN 3 ELSE conv_id END AS conv_id, CASE WHEN conv_id % 3 = 0 THEN conv_id * 10 + turn ELSE turn END AS turn)",
}
NAMES = ["j_edge_endpoints", "j_distant_label", "j_pairs_unordered", "j_doc_pairs", "j_mention_facts", "j_upsert_attributes", "a_hub_skew", "a_group_sentence",
         "g_query_graph", "g_context_batch", "m_nested_event", "m_doc_relation", "m_entity_recall", "p_balance", "p_role_list", "s_merge_datasets", "w_first_seen"]


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    import duckdb
    out = tmp_path_factory.mktemp("hot")
    con = duckdb.connect()
    for path in SOURCE.glob("*.parquet"):
        if path.stem in HOT:
            con.execute(f"COPY (SELECT {HOT[path.stem]} FROM '{path}') TO '{out}/{path.name}' (FORMAT parquet)")
        else:
            shutil.copyfile(path, out / path.name)
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, hot_dir, name):
    import __spark_entry__ as entry
    from oracle import compare, duck
    state, n, _, note = compare(spark, duck(hot_dir), name, entry.queries()[name], entry.oracle_sql()[name], hot_dir)
    assert state == "ok" and n > 0, note
