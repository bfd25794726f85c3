"""Queries p2 to p8 over the small tables: against SQL where there is one, else their invariants."""

import pytest
from conftest import same_rows

from wickerloom.llm.queries import CAPACITY, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        assert same_rows(got, duck.execute(ORACLES[name]).fetchdf()) is None
    elif name == "p5_found":
        rows = duck.execute("SELECT item_index, description, array_to_string(list_filter(features, lambda x: x IS NOT NULL), chr(10)) AS features FROM product_catalog").fetchall()
        want = {(i, k) for i, *texts in rows for k, t in zip(("description", "features"), texts) if len(" ".join((t or "").split())) > 1600}
        assert {*zip(got.item_index, got.chunk_type)} == want and len(got) == len(want)
    elif name == "p6_pack":
        assert got.groupby("container").n_tokens.sum().max() <= CAPACITY
        assert got.doc_id.nunique() == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    else:
        assert len(got.columns)
