"""The registered queries: their columns, their SQL forms, and that they cover their whole tables."""

import os

import duckdb
import pytest

from surfmesh.llm import queries

DIR = "/root/testdata/sf0.001"
#: Columns that come first, and whether a query has a row for each row of its table.
FIRST = {
    "op1_toxicity": (["doc_id", "held_out", "score", "predicted"], "documents"),
    "op2_sharding": (["doc_id", "shard", "n_bytes"], "documents"),
    "op3_html_mincut": (["page_id", "url", "text", "n_chars"], "pages"),
    "op4_compression_bands": (["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "documents"),
    "op5_line_winnowing": (["doc_id", "text", "n_removed", "removed"], "documents"),
    "op6_warc_zip": (["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "pages"),
    "op7_simhash": (["doc_id", "fingerprint", "component_id"], "documents"),
    "op8_unit_dedup": (["doc_id", "text", "n_removed", "removed"], "documents"),
    "op9_decontamination": (["doc_id", "item_id", "similarity"], None),
    "op10_mixing": (["doc_id", "source", "block", "slot", "position", "in_target"], "documents"),
}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def test_all_are_registered():
    assert list(queries.QUERIES) == list(FIRST)


@pytest.mark.parametrize("name", FIRST)
def test_query(spark, name):
    columns, table = FIRST[name]
    df = queries.QUERIES[name](spark, DIR)
    assert df.columns[: len(columns)] == columns
    rows = df.collect()
    if table:
        assert len(rows) == spark.read.parquet(f"{DIR}/{table}.parquet").count()
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(DIR):
            con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
        want = con.sql(queries.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        order = [want.columns.index(c) for c in df.columns]
        assert sorted(map(repr, (tuple(r[i] for i in order) for r in want.fetchall()))) == sorted(map(repr, map(tuple, rows)))
