"""Every unit is audited, with its whole first sentence."""

import pyarrow as pa
import pyarrow.parquet as pq

from quirework.plans.queries import QUERIES


def test_audit_units(spark, tmp_path):
    long = "On 5 May at 10 p.m. the council of the district measured the whole revenue of the market"
    rows = [
        (1, "d", long + ". Then it ended.", "h1"), (2, "d", "Before. " + long.upper() + ". After.", "h2"), (3, "d", long + " twice. Then.", "h3"),
        (5, "e", long + ". Then it ended.", "h5"), (7, "e", None, "h7"), (20, "f", "Alone here. Again.", "h20"), (40, "g", "Alone here. More.", "h40"), (41, "g", "Said: alone here.", "h41"), (42, "g", "x", "h42"),
    ]
    columns = {"ldu_id": pa.int64(), "doc_id": pa.string(), "content": pa.string(), "content_hash": pa.string(), "ingested_at": pa.timestamp("us")}
    pq.write_table(pa.table({k: pa.array([(r + (0,))[i] for r in rows], t) for i, (k, t) in enumerate(columns.items())}), tmp_path / "ldus.parquet")
    got = {r["claim_id"]: (r["status"], r["hashes"]) for r in QUERIES["audit_units"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 5, 7, 20, 40, 41, 42]
    assert {k: n for k, (status, n) in got.items() if status == "Verified"} == {1: 2, 40: 2}
