"""Every query of the package runs on the small tables with stable columns, and says the same as its SQL where there is one."""

import pytest

from shelfmark.llm import queries as Q
from tests.compare import rows

COLUMNS = {"p1_found": ["name_a", "name_b"], "p3_found": ["field", "row_id"], "p4_found": ["doc_id", "field"], "p5_found": ["sha256", "doc_id", "path_id"], "p8_found": ["doc_id", "kind", "start_pos"]}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, data, duck, name):
    df = Q.queries()[name](spark, data)
    got = df.toPandas()
    assert name not in COLUMNS or list(got.columns) == COLUMNS[name]
    if name.endswith("_found"):
        assert not got.duplicated().any()
    if name in Q.oracle_sql():
        assert rows(got) == rows(duck.execute(Q.oracle_sql()[name]).df())
