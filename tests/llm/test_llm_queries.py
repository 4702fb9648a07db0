"""Every registered query of the subpackage on the test data, against its SQL where there is one."""

import pytest
from conftest import same

from metricloom.llm import ORACLES, QUERIES

COLUMNS = {
    "p1_found": [("dataset_id", "int"), ("metric_name", "string")], "p2_found": [("seq_id", "bigint"), ("span_start", "int"), ("span_end", "int")],
    "p4_found": [("first_row_id", "bigint"), ("row_id", "bigint")], "p5_found": [("row_id_a", "bigint"), ("row_id_b", "bigint")], "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p7_found": [("mix_id", "int"), ("source", "string")], "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, oracle, name):
    same(QUERIES[name](spark, data), oracle, ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, data, name):
    assert QUERIES[name](spark, data).dtypes == COLUMNS[name]


def test_found_mixes_by_hand(spark, data, oracle):
    ids = QUERIES["p6_ids"](spark, data).selectExpr("doc_id", "size(ids) n").toPandas()
    oracle.register("token_sizes", ids)
    want = oracle.execute("""WITH s AS (SELECT source, sum(n) AS t FROM token_sizes JOIN documents USING (doc_id) GROUP BY 1), a AS (SELECT sum(n) AS t FROM token_sizes)
      SELECT mix_id, m.source FROM mix_targets m LEFT JOIN s USING (source), a WHERE max_uses * coalesce(s.t, 0) < target_share * size_ratio * a.t""").fetchall()
    assert sorted(map(tuple, QUERIES["p7_found"](spark, data).collect())) == sorted(want)
