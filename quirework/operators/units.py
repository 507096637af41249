"""Measured quantities in common units.

Units are vertices of a graph, conversions are affine edges y = a*x + b. The shortest composition from every unit to
its quantity's common unit is found once on the driver (the graph is a constant of a few dozen units), every other
path is checked against it, and the resulting table of at most MAX_UNITS rows is joined on the parsed unit.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.session import broadcast_if_small, materialize, small_rows

MAX_UNITS = 1000
TOLERANCE = 0.005

# Conversions (from, to, factor, offset) with to = factor * from + offset.
EDGES = [
    ("g", "kg", 0.001, 0.0), ("t", "kg", 1000.0, 0.0), ("kt", "t", 1000.0, 0.0), ("quintal", "kg", 100.0, 0.0),
    ("lb", "kg", 0.45359237, 0.0), ("t", "g", 1e6, 0.0), ("mg", "g", 0.001, 0.0), ("oz", "lb", 0.0625, 0.0),
    ("Wh", "kWh", 0.001, 0.0), ("MWh", "kWh", 1000.0, 0.0), ("GWh", "MWh", 1000.0, 0.0), ("TWh", "GWh", 1000.0, 0.0),
    ("kWh", "MJ", 3.6, 0.0), ("GJ", "MJ", 1000.0, 0.0), ("TJ", "GJ", 1000.0, 0.0), ("kJ", "MJ", 0.001, 0.0),
    ("MWh", "GJ", 3.6, 0.0), ("PJ", "TJ", 1000.0, 0.0),
    ("m2", "ha", 0.0001, 0.0), ("km2", "ha", 100.0, 0.0), ("km2", "m2", 1e6, 0.0), ("acre", "m2", 4046.8564224, 0.0),
    ("acre", "ha", 0.40468564224, 0.0),
    ("m", "km", 0.001, 0.0), ("ft", "m", 0.3048, 0.0), ("mile", "km", 1.609344, 0.0), ("mile", "ft", 5280.0, 0.0),
    ("cm", "m", 0.01, 0.0), ("mm", "m", 0.001, 0.0), ("yd", "ft", 3.0, 0.0), ("in", "cm", 2.54, 0.0),
    ("l", "m3", 0.001, 0.0), ("hl", "l", 100.0, 0.0), ("ML", "m3", 1000.0, 0.0), ("ML", "l", 1e6, 0.0),
    ("bbl", "l", 158.987, 0.0), ("GL", "ML", 1000.0, 0.0), ("mL", "l", 0.001, 0.0),
    ("Mt", "kt", 1000.0, 0.0), ("mJ", "kJ", 1e-6, 0.0), ("mW", "W", 0.001, 0.0),
    ("K", "°C", 1.0, -273.15), ("°F", "°C", 5 / 9, -160 / 9), ("°F", "K", 5 / 9, 273.15 - 160 / 9),
    ("ratio", "percent", 100.0, 0.0), ("bps", "percent", 0.01, 0.0), ("per mille", "percent", 0.1, 0.0),
    ("ratio", "bps", 10000.0, 0.0),
    ("W", "kW", 0.001, 0.0), ("MW", "kW", 1000.0, 0.0), ("GW", "MW", 1000.0, 0.0), ("TW", "GW", 1000.0, 0.0),
]

# Spellings, in lower case, of each unit. A currency other than ETB is a unit without an edge.
SPELLINGS = {
    "kg": "kg kgs kilogram kilograms kilo kilos kilogramme kilogrammes",
    "g": "g gram grams gramme grammes",
    "mg": "mg milligram milligrams",
    "t": "t tonne tonnes mt|metric ton|metric tons|metric tonne|metric tonnes",
    "kt": "kt kiloton kilotons kilotonne kilotonnes",
    "quintal": "quintal quintals qtl",
    "lb": "lb lbs pound pounds",
    "oz": "oz ounce ounces",
    "Wh": "wh|watt hour|watt hours",
    "kWh": "kwh|kilowatt hour|kilowatt hours|kilowatt-hour|kilowatt-hours",
    "MWh": "mwh|megawatt hour|megawatt hours|megawatt-hour|megawatt-hours",
    "GWh": "gwh|gigawatt hour|gigawatt hours|gigawatt-hour|gigawatt-hours",
    "TWh": "twh|terawatt hour|terawatt hours",
    "kJ": "kj kilojoule kilojoules",
    "MJ": "mj megajoule megajoules",
    "GJ": "gj gigajoule gigajoules",
    "TJ": "tj terajoule terajoules",
    "PJ": "pj petajoule petajoules",
    "ha": "ha hectare hectares",
    "m2": "m2 m² sqm|sq m|square metre|square metres|square meter|square meters|m^2",
    "km2": "km2 km²|sq km|square kilometre|square kilometres|square kilometer|square kilometers|km^2",
    "acre": "acre acres",
    "m": "m metre metres meter meters",
    "km": "km kms kilometre kilometres kilometer kilometers",
    "ft": "ft foot feet",
    "mile": "mile miles mi",
    "cm": "cm centimetre centimetres centimeter centimeters",
    "mm": "mm millimetre millimetres millimeter millimeters",
    "yd": "yd yard yards",
    "in": "inch inches",
    "m3": "m3 m³ cbm|cu m|cubic metre|cubic metres|cubic meter|cubic meters|m^3",
    "l": "l litre litres liter liters",
    "hl": "hl hectolitre hectolitres hectoliter hectoliters",
    "ML": "ml megalitre megalitres megaliter megaliters",
    "GL": "gl gigalitre gigalitres",
    "bbl": "bbl barrel barrels",
    "°C": "°c ℃ celsius|deg c|degrees c|degrees celsius|deg celsius|° c",
    "°F": "°f ℉ fahrenheit|deg f|degrees f|degrees fahrenheit|deg fahrenheit|° f",
    "K": "k kelvin kelvins",
    "percent": "percent % pct|per cent|percentage points",
    "ratio": "ratio fraction",
    "bps": "bps bp|basis points|basis point",
    "per mille": "per mille|‰|permille|per mil",
    "W": "w watt watts",
    "kW": "kw kilowatt kilowatts",
    "MW": "mw megawatt megawatts",
    "GW": "gw gigawatt gigawatts",
    "TW": "tw terawatt terawatts",
    "ETB": "etb birr br birrs|ethiopian birr",
    "USD": "usd $ us$ dollar dollars|us dollars",
    "EUR": "eur € euro euros",
    "GBP": "gbp £|pounds sterling",
    "KES": "kes",
}
# Spellings that mean another unit in this case than in capitals or small letters throughout (250 ml is no
# megalitre), and their units. They are looked up as written, before all others.
EXACT = {"ml": "mL", "mL": "mL", "Mg": "t", "mg": "mg", "mW": "mW", "mJ": "mJ", "Mt": "Mt"}
# Scale words.
SCALES = {
    "hundred": 1e2, "thousand": 1e3, "thousands": 1e3, "lakh": 1e5, "lakhs": 1e5, "million": 1e6, "millions": 1e6,
    "mn": 1e6, "mln": 1e6, "crore": 1e7, "crores": 1e7, "billion": 1e9, "billions": 1e9, "bn": 1e9, "trillion": 1e12, "tn": 1e12,
}


class InconsistentUnits(ValueError):
    """Two paths between the same units disagree."""


def compositions(edges: list[tuple], targets: list[str], rel: float = 1e-6) -> dict[str, tuple[str, float, float]]:
    """unit -> (target, a, b), the shortest composition of edges (either way) to a target; raises InconsistentUnits if another path differs."""
    near: dict[str, list[tuple[str, float, float]]] = {}
    for u, v, a, b in edges:
        near.setdefault(u, []).append((v, a, b))
        near.setdefault(v, []).append((u, 1 / a, -b / a))
    found: dict[str, tuple[str, float, float]] = {}
    for target in targets:
        if target in found:
            raise InconsistentUnits(f"{target} and {found[target][0]} measure the same quantity")
        found[target] = (target, 1.0, 0.0)
        queue = deque([target])
        while queue:
            v = queue.popleft()
            for u, a, b in near.get(v, []):  # v -> u is y = a*x + b, so u -> v is its inverse
                _, va, vb = found[v]
                to = (target, va / a, vb - va * b / a)
                if u not in found:
                    found[u] = to
                    queue.append(u)
                elif found[u][0] != target or any(not math.isclose(x, y, rel_tol=rel, abs_tol=rel) for x, y in zip(found[u][1:], to[1:], strict=True)):
                    raise InconsistentUnits(f"{u}: {found[u]} and {to}")
    return found


def unit_table(spark: SparkSession, common_units: DataFrame, edges: list[tuple] | None = None) -> DataFrame:
    """(spelling, unit, quantity, common_unit, factor, offset) for every known spelling; the last four are null for a unit that has no way to a common unit."""
    rows = small_rows(common_units.select("quantity", "unit").filter("unit IS NOT NULL").distinct(), MAX_UNITS)
    spelling = {w.strip(): unit for unit, text in SPELLINGS.items() for part in text.split("|") for w in ([part] if " " in part and part.split()[0] in ("metric", "watt", "kilowatt", "megawatt", "gigawatt", "terawatt", "sq", "square", "cu", "cubic", "deg", "degrees", "°", "per", "percentage", "basis", "ethiopian", "us", "pounds") else part.split())}
    spelling |= {unit.lower(): unit for unit in SPELLINGS if unit.lower() not in spelling}
    spelling |= {f"={s}": unit for s, unit in EXACT.items()}
    target = {spelling.get(r["unit"].strip().lower(), r["unit"]): (r["quantity"], r["unit"]) for r in rows}
    ways = compositions(EDGES if edges is None else edges, list(target))
    data = [(s, u, *(target[ways[u][0]] if u in ways else (None, None)), *(ways[u][1:] if u in ways else (None, None))) for s, u in sorted(spelling.items())]
    return spark.createDataFrame(data, "spelling string, unit_code string, quantity string, common_unit string, factor double, offset double")


def _clean(text: Column) -> Column:
    c = F.lower(F.trim(F.regexp_replace(text, "[\\s    ]+", " ")))
    c = F.regexp_replace(c, "[\u2212\u2013]", "-")
    c = F.regexp_replace(c, "[’ʼ]", "'")
    return F.regexp_replace(c, r"(^|[^\d])'000\b", "$1 thousand ")


def _let(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def _number(digits: Column) -> Column:
    """The number written in digits (no sign): one point is decimal, one comma before exactly three final digits groups, of two kinds of mark the last is decimal, repeated marks group."""

    def read(n: Column) -> Column:
        exponent = F.regexp_extract(n, r"e([+-]?\d+)$", 1)

        def plain(m: Column) -> Column:
            points, commas = F.length(m) - F.length(F.replace(m, F.lit("."), F.lit(""))), F.length(m) - F.length(F.replace(m, F.lit(","), F.lit("")))
            no_comma, no_point = F.replace(m, F.lit(","), F.lit("")), F.replace(m, F.lit("."), F.lit(""))
            comma_decimal = F.replace(no_point, F.lit(","), F.lit("."))
            return (
                F.when((points > 0) & (commas > 0), F.when(F.instr(F.reverse(m), ".") < F.instr(F.reverse(m), ","), no_comma).otherwise(comma_decimal))
                .when(points > 1, no_point)
                .when(commas > 1, no_comma)
                .when(commas == 1, F.when(m.rlike(r",\d{3}$"), no_comma).otherwise(comma_decimal))
                .otherwise(m)
            )

        return F.concat(_let(F.regexp_extract(n, r"^([\d.,]*)", 1), plain), F.when(exponent != "", F.concat(F.lit("e"), exponent)).otherwise("")).try_cast("double")

    return _let(F.translate(digits, " '", ""), read)


def _phrase(text: Column) -> tuple[Column, Column]:
    """(scale, spelling) of a unit phrase in any order of its words."""
    words = F.filter(F.split(text, r"[()\[\]\s]+"), lambda w: w != "")
    scales = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    scale = F.aggregate(words, F.lit(1.0), lambda acc, w: acc * F.coalesce(scales[w], F.lit(1.0)))
    return scale, F.array_join(F.filter(words, lambda w: scales[w].isNull()), " ")


def parse_quantities(facts: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """Adds number (sign applied), scale and spelling to facts.

    number is null where value is null, blank or has no digits; spelling is '' where neither value nor unit names a unit.
    A scale word in value multiplies; a unit written in both value and unit is one unit; of two different units, the one in value holds.
    """
    noted = F.regexp_replace(_clean(F.col(value)), r"\[[^\]]*\]|\*|†|\((?:unaudited|audited|provisional|revised|restated|estimated?|prov\.|est\.|r|p|e)\)", " ")
    noted = F.trim(F.regexp_replace(noted, r"^\s*(?:approximately|approx\.?|about|around|some|circa|ca\.|c\.|nearly|~|≈)\s*", ""))
    written = r"(\(?)\s*([-+]?)\s*(?<![a-z0-9.,])(\d(?:[\d.,' ]*\d)?(?:e[+-]?\d+)?)(\s*\))?"
    out = facts.withColumn("_noted", noted).withColumn("_found", F.nullif(F.regexp_extract("_noted", written, 0), F.lit("")))
    digits = F.regexp_extract("_noted", written, 3)
    negative = (F.regexp_extract("_noted", written, 2) == "-") | ((F.regexp_extract("_noted", written, 1) == "(") & (F.regexp_extract("_noted", written, 4) != ""))
    start = F.instr(F.col("_noted"), F.col("_found"))
    rest = F.concat_ws(" ", F.substring(F.col("_noted"), F.lit(1), start - 1), F.substring(F.col("_noted"), start + F.length("_found"), F.length("_noted")))
    scale_v, spell_v = _phrase(rest)
    scale_u, spell_u = _phrase(_clean(F.col(unit)))
    out = out.withColumns({"_sv": F.coalesce(F.when(F.col("_found").isNotNull(), scale_v), F.lit(1.0)), "_bv": F.coalesce(F.when(F.col("_found").isNotNull(), spell_v), F.lit("")), "_su": F.coalesce(scale_u, F.lit(1.0)), "_bu": F.coalesce(spell_u, F.lit(""))})
    scale = F.when(F.col("_bv") == "", F.col("_sv") * F.col("_su")).when((F.col("_sv") == 1.0) & (F.col("_bu") != ""), F.col("_su")).otherwise(F.col("_sv"))
    value_of = _number(digits)
    # The unit as it is written, for the few whose case tells them apart.
    in_value = F.col("_bv") != ""
    spelled = F.when(in_value, F.col("_bv")).otherwise(F.col("_bu"))
    so = F.when(F.col("_sp").isin(sorted({s.lower() for s in EXACT})), F.nullif(F.regexp_extract(F.when(in_value, F.col(value)).otherwise(F.col(unit)), rf"(?<!\p{{L}})({'|'.join(EXACT)})(?!\p{{L}})", 1), F.lit("")))
    number = F.when(F.col("_found").isNotNull(), value_of * F.when(negative, -1.0).otherwise(1.0))
    return out.withColumns({"number": number, "scale": scale, "_sp": spelled}).withColumn("spelling", F.coalesce(F.concat(F.lit("="), so), F.col("_sp"))).drop("_sp", "_noted", "_found", "_sv", "_bv", "_su", "_bu")


def normal_period(period: Column) -> Column:
    """One form: 2011, 2011-Q3 or 2011/12 (July to June); null for null, blank or unknown spellings."""
    cleaned = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.regexp_replace(period, "[–−]", "-"), "[\\s ]+", " "))), r"^fy ?", "")

    def read(p: Column) -> Column:
        year = F.regexp_extract(p, r"(\d{4})", 1)
        ranges = {"jan-mar": "1", "apr-jun": "2", "jul-sep": "3", "oct-dec": "4"}
        month_quarter = F.regexp_extract(F.regexp_replace(p, r" ?- ?", "-"), r"^([a-z]{3})[a-z]*-([a-z]{3})[a-z]* \d{4}$", 0)
        months = F.regexp_replace(F.regexp_extract(month_quarter, r"^([a-z-]+)", 1), r"([a-z]{3})[a-z]*", "$1")
        quarter = F.coalesce(
            F.nullif(F.regexp_extract(p, r"^(?:q([1-4])[ -/]?\d{4})$", 1), F.lit("")),
            F.nullif(F.regexp_extract(p, r"^\d{4}[ -/]?q([1-4])$", 1), F.lit("")),
            F.nullif(F.regexp_extract(p, r"^([1-4])(?:st|nd|rd|th) quarter(?: of)? \d{4}$", 1), F.lit("")),
            F.create_map(*[F.lit(x) for pair in ranges.items() for x in pair])[months],
        )
        second = F.regexp_extract(p, r"^\d{4} ?[/-] ?(\d{2}|\d{4})$", 1)
        following = F.when(year != "", year.try_cast("int") + 1)
        split = (F.right(second, F.lit(2)) == F.right(following.cast("string"), F.lit(2))) & (second != "")
        split = split | (F.regexp_extract(F.regexp_replace(p, r" ?- ?", "-"), r"^jul[a-z]* \d{4}-jun[a-z]* (\d{4})$", 1) == following.cast("string"))
        whole = p.rlike(r"^(?:(?:calendar )?year )?\d{4}(?: ?\((?:full|calendar|whole) year\))?$") | (months == "jan-dec")
        return F.when(split, F.concat(year, F.lit("/"), F.right(following.cast("string"), F.lit(2)))).when(quarter.isNotNull() & (year != ""), F.concat(year, F.lit("-Q"), quarter)).when(whole, year)

    return _let(cleaned, read)


def common_quantities(facts: DataFrame, common_units: DataFrame) -> DataFrame:
    """Every fact once (the row delivered last of an id) with period, quantity, common_unit, common_value.

    quantity, common_unit and common_value are null for facts without a number or a unit with a way to a common unit.
    Facts with a null id are left out: without a key nothing can refer to them. Other columns of facts are kept under their names.
    """
    names = facts.columns
    latest = facts.filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*names), F.struct(F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0))), F.xxhash64("value", "unit", "time_period"))).alias("_r")).select("_r.*")
    units = broadcast_if_small(unit_table(facts.sparkSession, common_units), MAX_UNITS)
    clash = [c for c in ("number", "scale", "spelling", "unit_code", "quantity", "common_unit", "factor", "offset", "period", "common_value") if c in names]
    parsed = parse_quantities(latest.drop(*clash)).join(units, "spelling", "left")
    value = F.col("number") * F.col("scale") * F.col("factor") + F.col("offset")
    return parsed.withColumns({"common_value": value, "period": normal_period(F.col("time_period"))}).drop("spelling", "scale", "factor", "offset")


def equal_facts(quantities: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(id_a, id_b), id_a < id_b: facts of one entity, period and quantity whose common values differ by at most tolerance of the larger, in magnitude.

    Values within the tolerance lie in the same or in neighbouring buckets of width ln(1/(1-tolerance)) on the log scale, so the
    join is an equi-join on entity, period, quantity, sign and bucket: a hot entity spreads over its buckets, and AQE splits what is still skewed.
    """
    usable = quantities.filter("entity IS NOT NULL AND period IS NOT NULL AND common_value IS NOT NULL AND unit_code IS NOT NULL AND NOT isnan(common_value)")
    width = -math.log1p(-tolerance) * (1 + 1e-9) if tolerance > 0 else 1.0
    v = F.col("common_value")
    keyed = usable.select("id", "entity", "period", "quantity", F.signum(v).cast("int").alias("sgn"), v.alias("v"), F.when(v == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs(v)) / width)).cast("long").alias("bucket"))
    keyed = materialize(keyed, "quantities")  # both sides of the join read it; parsing is the dear part
    left = keyed.select(F.col("id").alias("l"), "entity", "period", "quantity", "sgn", F.col("v").alias("lv"), "bucket")
    right = keyed.select(F.col("id").alias("r"), "entity", "period", "quantity", "sgn", F.col("v").alias("rv"), F.explode(F.array(F.struct(F.col("bucket"), F.lit(False).alias("next")), F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(True).alias("next")))).alias("x")).select("r", "entity", "period", "quantity", "sgn", "rv", "x.bucket", "x.next")
    near = F.abs(F.col("lv") - F.col("rv")) <= tolerance * F.greatest(F.abs("lv"), F.abs("rv")) * (1 + 1e-9)
    return left.join(right, ["entity", "period", "quantity", "sgn", "bucket"]).filter((F.col("next") | (F.col("l") < F.col("r"))) & near).select(F.least("l", "r").alias("id_a"), F.greatest("l", "r").alias("id_b"))
