"""Queries of the subpackage: columns fixed by the data description, SQL where there is some, a full run of the others."""

import glob
import os

import duckdb
import pytest

from quirework.llm.queries import ORACLE, QUERIES

FOUND = {"p1_found": ["ldu_id"], "p3_found": ["ldu_id_a", "ldu_id_b"], "p4_found": ["block_id", "line_no"], "p5_found": ["doc_id", "language"], "p7_found": ["record_kind", "record_id", "defect"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "sentence_start"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    if name in FOUND:
        assert df.columns == FOUND[name] and len(rows) == len(set(rows)) and rows
    if name in ORACLE:
        con = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        want = con.execute(ORACLE[name])
        assert sorted(d[0] for d in want.description) == sorted(df.columns)
        order = [d[0] for d in want.description]
        assert sorted(map(str, df.select(*order).collect()[:0])) == [] and sorted(tuple(r) for r in df.select(*order).collect()) == sorted(want.fetchall())
