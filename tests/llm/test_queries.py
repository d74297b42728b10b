"""The registered queries: those with SQL against it, all of them for columns and rows."""

import pytest

from sparsecg.llm.oracle import ORACLE_SQL
from sparsecg.llm.queries import QUERIES

COLUMNS = {
    "op1": ["page_id", "url", "text", "n_chars"],
    "op2": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3": ["doc_id", "text"],
    "op4": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op5": ["vec_id", "n_links", "component_id", "kept"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8": ["doc_id", "fingerprint", "component_id"],
    "op9": ["page_id", "record_type", "record_id", "refers_to"],
    "op10": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_columns_and_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    op = name.split("_")[0]
    assert set(COLUMNS[op]) <= set(df.columns)
    source = spark.read.parquet(f"{sf_dir}/{'pages' if op in ('op1', 'op9') else 'documents'}.parquet").count()
    assert df.count() == source * (3 if op == "op9" else 1) or op == "op10" and df.count() >= source
