import pytest
from pyspark.sql import functions as F

from quirework.operators import units

COMMON = [("money", "ETB"), ("energy", "kWh"), ("mass", "kg"), ("area", "ha"), ("length", "km"), ("volume", "m3"), ("temperature", "°C"), ("share", "percent"), ("power", "kW")]
FACTS = "id bigint, entity string, value string, unit string, time_period string, ingested_at timestamp"

CASES = [
    ("5,725,800", "metres", 5725.8), ("0.821267", "ETB bn", 821267000.0), ("821.27 million birr", "birr", 821270000.0), ("some 2.078,9 kg", None, 2078.9),
    ("9.993,53 lakh birr", None, 999353000.0), ("~434'700 m²", None, 43.47), ("5.50328E+8", "Br", 550328000.0), ("8 245,4 lakh birr", None, 824540000.0),
    ("0,032928", "'000 ha", 32.928), ("19,430", "ETB '000", 19430000.0), ("(235.487) lakh birr", "lakh birr", -23548700.0), ("-112,707 thousand birr", "birr", -112707000.0),
    ("0.96438 million ETB", "million ETB", 964380.0), ("4,359.5 thousand", "Br", 4359500.0), ("160.3 Fahrenheit", "Fahrenheit", (160.3 - 32) * 5 / 9), ("300", "K", 26.85),
    ("0.4185", "KM2", 41.85), ("1,187.3 [r]", "bps", 11.873), ("97,532", "kg", 97532.0), ("82,4428", "ML", 82442.8), ("1", "bbl", 0.158987), ("250 ml", None, 0.00025), ("250", "mL", 0.00025), ("250", "ML", 250_000.0), ("3 Mg", None, 3000.0), ("3", "mg", 3e-6), ("5 mW", "mW", 5e-6), ("5", "MW", 5000.0), ("2 Mt", "", 2e9), ("2", "MT", 2000.0), ("2 mt", None, 2000.0), ("3.6", "GJ", 1000.0), ("~ETB 0.5 mn", None, 500000.0),
    ("0.5559 (ratio)", None, 55.59), ("9.9%", "", 9.9), ("see note b", "kg", None), ("..", "kg", None), ("12", "USD", None), ("12", "", None), (None, "kg", None), ("12", None, None), ("", "", None),
]


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame(COMMON, "quantity string, unit string")


def test_values(spark, common):
    rows = [(i, "e", v, u, "2011", None) for i, (v, u, _) in enumerate(CASES)]
    got = {r["id"]: r["common_value"] for r in units.common_quantities(spark.createDataFrame(rows, FACTS), common).collect()}
    for i, (v, u, want) in enumerate(CASES):
        assert got[i] == (None if want is None else pytest.approx(want, rel=1e-9)), (v, u)


def test_periods(spark):
    cases = {"2011": "2011", "FY2011": "2011", "FY 2011": "2011", "Jan-Dec 2011": "2011", "2011 (full year)": "2011", "year 2011": "2011", "2012Q1": "2012-Q1", "2021-Q4": "2021-Q4", "Q2 2010": "2010-Q2", "2nd quarter 2010": "2010-Q2", "Apr-Jun 2010": "2010-Q2", "FY2014/15": "2014/15", "2013/2014": "2013/14", "2019-20": "2019/20", "Jul 2021 - Jun 2022": "2021/22", " fy2013/14 ": "2013/14", "2019-25": None, "soon": None, "": None, None: None}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", units.normal_period(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in got} == cases


def test_graph():
    found = units.compositions(units.EDGES, ["kWh", "kg", "°C"])
    assert found["TJ"][1] == pytest.approx(1e6 / 3.6) and found["lb"][0] == "kg"
    with pytest.raises(units.InconsistentUnits):
        units.compositions([*units.EDGES, ("TJ", "kWh", 5.0, 0.0)], ["kWh"])


def test_pairs_against_brute_force(spark, common):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), str(round(rng.choice([1, -1]) * rng.choice([0, 10, 10.02, 10.049, 10.06, 1000]) * rng.uniform(0.999, 1.001), 6)), rng.choice(["kg", "t", "USD", None]), rng.choice(["2011", "FY2011", "2012", None]), None) for i in range(300)]
    facts = spark.createDataFrame(rows, FACTS)
    q = units.common_quantities(facts.unionByName(facts), common)
    v = [r for r in q.collect() if r["common_value"] is not None and r["period"]]
    want = {(a["id"], b["id"]) for a in v for b in v if a["id"] < b["id"] and (a["entity"], a["period"], a["quantity"]) == (b["entity"], b["period"], b["quantity"]) and abs(a["common_value"] - b["common_value"]) <= 0.005 * max(abs(a["common_value"]), abs(b["common_value"]))}
    got = [tuple(r) for r in units.equal_facts(q).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_odd_tables(spark, common):
    empty = spark.createDataFrame([], FACTS)
    assert units.equal_facts(units.common_quantities(empty, common)).count() == 0
    rows = [(None, None, None, None, None, None), (1, "e", "9" * 5000, "kg", "2011", None), (1, "e", "9" * 5000, "kg", "2011", None), (2, None, "5", "kg", "2011", None)]
    clash = spark.createDataFrame(rows, FACTS).withColumn("number", F.lit("mine")).withColumn("period", F.lit(0))
    assert units.common_quantities(clash, common).count() == 2
