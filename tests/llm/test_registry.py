"""The registered queries: names, SQL, and the whole-table results."""

import pytest

from __spark_entry__ import oracle_sql, queries
from crease.llm.registry import ORACLE_SQL, QUERIES
from tools.compare_oracle import compare

DIR = "/root/testdata/sf0.01"


def test_one_query_per_operator_and_the_pipeline():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) < set(queries()) and "pipeline" in queries()
    assert set(ORACLE_SQL) <= set(oracle_sql()) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_its_sql(spark, name):
    assert compare(spark, DIR, [name], verbose=False)[name][0] == "OK"


COLUMNS = {
    "op2": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op3": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint",
            "sequence_id": "bigint", "offset": "bigint"},
    "op4": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op6": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint",
            "base_score": "double", "score": "double"},
    "op10": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
             "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op11": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op12": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string",
             "contaminated": "boolean"},
    "op13": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint",
             "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert COLUMNS.get(name.split("_")[0], {}).items() <= dict(df.dtypes).items()
    table = {"op1": "pages", "op6": None, "op3": None, "op11": None, "op13": None}.get(name.split("_")[0], "documents")
    if table:
        assert df.count() == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    else:
        assert df.count() > 0
