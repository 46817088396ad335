import math

import pytest

from threadloom.llm import catalogue

from .. import oracle

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, data, name):
    oracle.same(QUERIES[name](spark, data), oracle.connection(data), SQL[name])


COLUMNS = {
    "p1_found": ["k", "x", "y"], "p3_found": ["first_row_id", "row_id"], "p4_found": ["row_id", "kind"], "p5_found": ["dataset_path", "sequence_index", "annotation_id"],
    "p6_found": ["participant", "source_path", "chat_index"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "language"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == COLUMNS[name]
    if name != "p8_ids":
        assert df.count() == df.distinct().count()


def test_log_odds_of_every_pair(spark, data):
    rows = QUERIES["p1_odds"](spark, data).collect()
    assert len(rows) == QUERIES["p1_pairs"](spark, data).count() > 0
    for r in rows:
        b, c = max(r.n_x * max(r.k, 1) - r.c_k, 0) + 0.5, max(r.n_y - r.c_k, 0) + 0.5
        d = max(r.scored_y - r.n_x - r.n_y + r.c_k, 0) + 0.5
        assert abs(r.log_odds - math.log((r.c_k + 0.5) * d / (b * c))) < 1e-5
