"""The registered queries over whole tables: against SQL where there is some, else their columns and keys."""

import pytest

from docloom.llm.queries import QUERIES
from docloom.llm.sql import SQL

from ..compare import connect, rows

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["ask_id", "defect"], "p2_found": ["chunk_id"], "p4_found": ["src", "rec_id", "end_pos"], "p5_found": ["src", "rec_id", "line_no", "defect"], "p6_found": ["book_id", "page_number", "line_no"],
    "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.toPandas()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        if name != "p7_ids":
            assert not got.duplicated().any()
    if name in SQL:
        assert rows(got) == rows(connect(FOLDER).sql(SQL[name]).df())
