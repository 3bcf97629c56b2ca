"""Quantities recorded in different units (problem 3).

Units are chosen by physical identities, of all that a record's text may mean the one with the least log residual:

* Records of one book and subject measure the same quantity, so their logarithms in a common unit are equal (`quantities`). What a record may mean
  is looked for where a unit may be recorded, from the nearest place on: after the number, in the unit column, in the parameter's
  brackets, in the header of the column that holds the value. A spelling may stand for several units (`mw`: megawatt or milliwatt), and what is
  spelled as a unit exactly may still be another in the wrong case (`mW` for MW), which must then fit while the exact one is ten times off. Each
  reading's residual is its distance from the median of the subject's records that have one reading or an exact spelling.
* The value and unit read from a page and the number and unit that the page says are one quantity (`identities`): for each book and pair of spellings
  the combination of units with the least residuals over its rows.
* Any identity among columns, such as mass = density x volume (`solve_units`): of each source the combination of units of all columns.

Where two readings fit alike, the more usual unit is taken and the record or source is flagged as not unique.

Scale: reading and looking up are one narrow pass; the table of spellings is fixed and broadcast, one join for each place, and a record goes on as a few
numbers. The records of a subject are reduced to one median by an aggregation with partial buffers. Pairs are found by an equi join on bands of the
logarithm a percent wide, never by comparing all records of a subject; a band that is full is split by adaptive execution.

Cases: null or empty values, words for none (`tbd`, `n/a`) and texts without a number have status `no_number`; a number without
a unit anywhere has status `unknown`, as does a unit that the table doesn't hold; repeated rows come out once; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import cut

# Prefixes with symbol, name and factor.
PREFIXES = {"m": ("milli", 1e-3), "c": ("centi", 1e-2), "h": ("hecto", 1e2), "k": ("kilo", 1e3), "M": ("mega", 1e6), "G": ("giga", 1e9)}
# Units that take prefixes: dimension, factor, prefixes in the order of use (more usual ones first), other symbols, names.
PREFIXED = {
    "Pa": ("pressure", 1.0, "MkhmG", "", "pascal pascals"),
    "bar": ("pressure", 1e5, "mkM", "bars", ""),
    "N": ("force", 1.0, "kMm", "", "newton newtons"),
    "g": ("mass", 1e-3, "km", "gr grs gm", "gram grams gramme grammes"),
    "m": ("length", 1.0, "mck", "mtr mtrs", "metre metres meter meters"),
    "W": ("power", 1.0, "kMmG", "", "watt watts"),
    "s": ("time", 1.0, "m", "sec secs", "second seconds"),
    "Hz": ("frequency", 1.0, "kMGm", "cps", "hertz"),
    "L": ("volume", 1e-3, "mch", "l ltr ltrs lt", "litre litres liter liters"),
    "rpm": ("rotation", 1.0, "k", "r/min rev/min 1/min min-1 u/min U/min", ""),
}
# Other units: dimension, factor, offset added before the factor, spellings.
OTHERS = {
    "atm": ("pressure", 101325.0, 0.0, ["atmosphere", "atmospheres", "atms"]),
    "psi": ("pressure", 6894.757293168361, 0.0, ["pounds per square inch", "pound per square inch", "lbf/in2", "lbf/in²", "lbf/in^2", "lb/in2", "lb/in²", "psia"]),
    "N/mm²": ("pressure", 1e6, 0.0, ["N/mm2", "N/mm^2", "newtons per square millimetre"]),
    "lbf": ("force", 4.4482216152605, 0.0, ["lb-f", "lbs-f", "pound-force", "pounds-force", "pound force", "pounds force"]),
    "kgf": ("force", 9.80665, 0.0, ["kp", "kg-f", "kilogram-force", "kilograms-force", "kilogram force", "kilopond", "kiloponds"]),
    "K": ("temperature", 1.0, 0.0, ["kelvin", "kelvins", "degK"]),
    "°C": ("temperature", 1.0, 273.15, ["C", "degC", "deg C", "° C", "degrees Celsius", "degree Celsius", "celsius", "℃", "degrees C"]),
    "°F": ("temperature", 5 / 9, 459.67, ["F", "degF", "deg F", "° F", "degrees Fahrenheit", "degree Fahrenheit", "fahrenheit", "℉", "degrees F"]),
    "t": ("mass", 1000.0, 0.0, ["tonne", "tonnes", "metric ton", "metric tons", "to"]),
    "lb": ("mass", 0.45359237, 0.0, ["lbs", "pound", "pounds", "lbm"]),
    "in": ("length", 0.0254, 0.0, ["inch", "inches", '"', "″", "”", "ins"]),
    "ft": ("length", 0.3048, 0.0, ["foot", "feet", "'", "′"]),
    "krpm": ("rotation", 1000.0, 0.0, ["thousand rpm", "x1000 rpm", "x 1000 rpm", "×1000 rpm", "1000 rpm", "thousand revolutions per minute"]),
    "rpm": ("rotation", 1.0, 0.0, ["revolutions per minute", "revolution per minute", "revs/min"]),
    "rev/s": ("rotation", 60.0, 0.0, ["rps", "r/s", "1/s", "revs/s", "revolutions per second", "revolution per second"]),
    "rad/s": ("rotation", 30 / math.pi, 0.0, ["radians per second", "radian per second", "rads/s", "rad/sec"]),
    "min": ("time", 60.0, 0.0, ["mins", "minute", "minutes"]),
    "h": ("time", 3600.0, 0.0, ["hr", "hrs", "hour", "hours"]),
    "kg": ("mass", 1.0, 0.0, ["kgs", "kilo", "kilos"]),
    "mL": ("volume", 1e-6, 0.0, ["ml", "cc", "ccm", "cm3", "cm³", "cm^3", "cubic centimetre", "cubic centimetres"]),
    "m³": ("volume", 1.0, 0.0, ["m3", "m^3", "cbm", "cu m", "cubic metre", "cubic metres", "cubic meter", "cubic meters"]),
}

_SPACE = r"[\s   ]"
#: Sign, whole digits with thousands apart, decimals, exponent in either form, and what follows.
NUMBER = (
    rf"^{_SPACE}*([-−–+]?){_SPACE}*([0-9]{{1,3}}(?:[,    '’][0-9]{{3}})+(?![0-9])|[0-9]+)([.,][0-9]+)?"
    rf"(?:[eE]([-−+]?[0-9]+)|{_SPACE}*[x×·*]{_SPACE}*10{_SPACE}*\^?{_SPACE}*([-−+]?[0-9]+))?{_SPACE}*(.*)$"
)
#: By how much (in decades) a reading in another letter case must fit better than the exact one.
INEXACT = 1.0
#: Residuals that differ by less than this fit alike.
ALIKE = 0.01
_NONE = 99.0


def spelling_rows() -> list[tuple[str, str, str, str, float, float, int]]:
    """(key, spelling, unit, dimension, factor, offset, rank): the spellings of every unit; key is the spelling in lower case, factor that to the
    coherent unit of the dimension, rank how usual the unit is among those with the same key."""
    rows: dict[tuple[str, str], tuple] = {}

    def add(spelling: str, unit: str, dimension: str, factor: float, offset: float, rank: int) -> None:
        rows.setdefault((spelling, unit), (spelling.lower(), spelling, unit, dimension, factor, offset, rank))

    for unit, (dimension, factor, offset, spellings) in OTHERS.items():
        for spelling in [unit, *spellings]:
            add(spelling, unit, dimension, factor, offset, 0)
    for base, (dimension, factor, prefixes, symbols, names) in PREFIXED.items():
        for spelling in [base, *symbols.split(), *names.split()]:
            add(spelling, base, dimension, factor, 0.0, 0)
        for rank, prefix in enumerate(prefixes):
            name, scale = PREFIXES[prefix]
            for symbol in [base, *symbols.split()]:
                add(prefix + symbol, prefix + base, dimension, factor * scale, 0.0, rank)
            for word in [*names.split(), *([base] if base == "bar" else [])]:
                add(name + word, prefix + base, dimension, factor * scale, 0.0, rank)
    return list(rows.values())


def units() -> list[tuple[str, str, float, float, int]]:
    """(unit, dimension, factor, offset, rank) of every unit; its place in this list is its number."""
    return sorted({(unit, dimension, factor, offset, rank) for _, _, unit, dimension, factor, offset, rank in spelling_rows()})


def attribute(number: Column, name: str) -> Column:
    """An attribute (unit, dimension, factor, offset, rank) of the unit with a number."""
    place = ("unit", "dimension", "factor", "offset", "rank").index(name)
    return F.get(F.array(*(F.lit(row[place]) for row in units())), number)


def spellings(spark: SparkSession, dimensions: set[str] | None = None) -> DataFrame:
    """One row per spelling in any letter case: the numbers of the units (of some dimensions) it may stand for, each with the spellings that stand for it
    exactly."""
    number = {row: i for i, row in enumerate(units())}
    by_key: dict[str, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
    for key, spelling, unit, dimension, factor, offset, rank in spelling_rows():
        if dimensions is None or dimension in dimensions:
            by_key[key][number[unit, dimension, factor, offset, rank]].add(spelling)
    data = [(k, [(i, sorted(own)) for i, own in sorted(found.items())]) for k, found in by_key.items()]
    return spark.createDataFrame(data, "unit_key string, candidates array<struct<id:int,spellings:array<string>>>").coalesce(1)


def clean_unit(text: Column) -> Column:
    """A unit's text without outer and double spaces and a full stop."""
    spaced = F.trim(F.regexp_replace(text, rf"{_SPACE}+", " "))
    return F.when(spaced != "", F.regexp_replace(spaced, r"(?<=\p{L})\.$", ""))


def parse_number(text: Column) -> Column:
    """struct(number, rest) of a text that begins with a number; null for others. The text is matched once; its parts are put
    side by side and taken from there."""
    parts = F.split(F.regexp_replace(F.translate(text, "\x01", " "), NUMBER, "$1\x01$2\x01$3\x01$4$5\x01$6"), "\x01")
    minus = lambda c: F.regexp_replace(c, "[−–]", "-")

    def read(p: Column) -> Column:
        part = lambda i: F.get(p, i)
        exponent = F.when(part(3) != "", F.concat(F.lit("e"), minus(part(3)))).otherwise("")
        literal = F.concat(minus(part(0)), F.regexp_replace(part(1), "[^0-9]", ""), F.replace(part(2), F.lit(","), F.lit(".")), exponent)
        return F.when(F.size(p) == 5, F.struct(literal.try_cast("double").alias("number"), clean_unit(part(4)).alias("rest")))

    read_once = F.get(F.transform(F.array(parts), read), 0)
    return F.struct(read_once["number"].alias("number"), read_once["rest"].alias("rest"))


def spec_records(spec: DataFrame) -> DataFrame:
    """(src, rec_id, book_id, subject, number, place_0, place_1): specs, what the page says before what was read from it."""
    after = F.when(F.startswith(F.lower("raw"), F.lower("subject")), F.substr("raw", F.length("subject") + 1)).otherwise(F.col("raw"))
    said = F.regexp_replace(after, rf"^{_SPACE}*(?:of|at|is|was|are|were|:|=){_SPACE}*", "")
    rows = spec.select("spec_id", "book_id", "subject", "unit", "value", parse_number(said).alias("_raw"))
    return rows.select(
        F.lit("spec").alias("src"), F.col("spec_id").alias("rec_id"), "book_id", F.lower(F.trim("subject")).alias("subject"),
        F.coalesce("_raw.number", F.when(~F.isnan("value"), F.col("value"))).alias("number"), F.col("_raw.rest").alias("place_0"), clean_unit(F.col("unit")).alias("place_1"),
    )


_BRACKET = r"^(.*?)[\s ]*(?:[\(\[][\s]*(?:in[\s]+)?([^\(\)\[\]]+?)[\s]*[\)\]]|,[\s]*(?:in[\s]+)?([^,]+))[\s]*$"


def table_records(table: DataFrame, known: list[str]) -> DataFrame:
    """(src, rec_id, book_id, subject, base, number, place_0 to place_4): rows of tables. The value is that of the value column, else of
    the first column of the row that is neither the parameter nor a unit and holds a number. The row's other cells are read only where the value or
    a `known` unit is still missing after the first two places. `subject` still carries a bracket, which is place_3, `base` doesn't."""
    is_unit = lambda e: F.lower(e["key"]).rlike(r"^\s*(?:units?|uom|measure)\s*$")
    cells = table.select("id", "book_id", "parameter", clean_unit(F.col("unit")).alias("_unit"), "row_data", parse_number(F.col("value")).alias("_value"))
    is_known = lambda c: F.coalesce(F.lower(c).isin(known), F.lit(False))
    complete = F.col("_value.number").isNotNull() & (is_known("_value.rest") | is_known("_unit"))
    cells = cells.withColumn("_cells", F.when(~complete, F.map_entries(F.from_json("row_data", "map<string,string>"))))
    named = F.filter("_cells", lambda e: e["value"].isNotNull() & (e["value"] != F.coalesce(F.col("parameter"), F.lit(""))) & ~is_unit(e))
    parsed = F.transform(named, lambda e: F.struct(e["key"].alias("header"), parse_number(e["value"]).alias("cell")))
    cell = F.get(F.filter(parsed, lambda e: e["cell"]["number"].isNotNull()), 0)
    unit_cell = F.get(F.filter("_cells", lambda e: is_unit(e) & (F.trim(e["value"]) != "")), 0)
    bracket = F.concat(F.regexp_extract("parameter", _BRACKET, 2), F.regexp_extract("parameter", _BRACKET, 3))
    rows = cells.select("id", "book_id", "parameter", "_unit", "_value", cell.alias("_cell"), unit_cell.alias("_unit_cell"), bracket.alias("_bracket"))
    header = F.regexp_extract("_cell.header", r"(?i)(?:[\(\[]\s*(?:in\s+)?([^\(\)\[\]]+?)\s*[\)\]]|\bin\s+(\S.*?))\s*$", 1)
    header_in = F.regexp_extract("_cell.header", r"(?i)\bin\s+([^\(\)\[\]]+?)\s*$", 1)
    own = F.col("_value.number").isNotNull()
    return rows.select(
        F.lit("table_row").alias("src"), F.col("id").alias("rec_id"), "book_id", F.lower(F.trim("parameter")).alias("subject"),
        F.lower(F.trim(F.when(F.col("_bracket") != "", F.regexp_extract("parameter", _BRACKET, 1)).otherwise(F.col("parameter")))).alias("base"),
        F.coalesce("_value.number", "_cell.cell.number").alias("number"), F.when(own, F.col("_value.rest")).otherwise(F.col("_cell.cell.rest")).alias("place_0"),
        F.col("_unit").alias("place_1"), clean_unit(F.col("_unit_cell.value")).alias("place_2"), clean_unit(F.col("_bracket")).alias("place_3"),
        clean_unit(F.concat(header, F.when(header == "", header_in).otherwise(""))).alias("place_4"),
    )


def _readings(records: DataFrame, table: DataFrame, places: list[str]) -> DataFrame:
    """Records with, for each place `p`, `p_readings`: the units (id, inexact) that its text may stand for; null for a text that is no unit. One join with the
    broadcast table of spellings for each place."""
    for place in places:
        own = F.broadcast(table.select(F.col("unit_key").alias(f"_key_{place}"), F.col("candidates").alias(f"_all_{place}")))
        records = records.join(own, F.lower(place) == F.col(f"_key_{place}"), "left")
        reading = F.transform(f"_all_{place}", lambda c: F.struct(c["id"].alias("id"), (~F.array_contains(c["spellings"], F.col(place))).alias("inexact")))  # noqa: B023
        records = records.withColumn(f"{place}_readings", reading).drop(f"_key_{place}", f"_all_{place}")
    return records


def common_units(unit_ref: DataFrame) -> dict[str, tuple[str, float, float]]:
    """The common unit of each dimension with its factor and offset: as many rows as there are dimensions with units here, a dozen."""
    known = {unit: (dimension, factor, offset) for unit, dimension, factor, offset, _ in units()}
    rows = unit_ref.where(F.col("dimension").isin({d for d, _, _ in known.values()}) & F.col("common_unit").isin(list(known))).groupBy("dimension").agg(F.min("common_unit").alias("u")).collect()
    return {r.dimension: (r.u, *known[r.u][1:]) for r in rows}


def _log(value: Column) -> Column:
    return F.when(value != 0, F.log10(F.abs(value)))


def ranked_readings(readings: Column, residual, inexact=None) -> Column:
    """Readings as struct(score, rank, residual, own), the best fit first: the core of every choice here. `residual` gives a reading's log residual, which may
    be null; without one, the exact spelling and the more usual unit come first. An inexact reading that doesn't fit stands behind all that are exact."""

    def scored(c: Column) -> Column:
        off = F.round(F.coalesce(residual(c), F.lit(_NONE)), 9)
        behind = F.when(~inexact(c), 0.0).when(off <= INEXACT, INEXACT).otherwise(_NONE) if inexact else F.lit(0.0)
        return F.struct((off + behind).alias("score"), c["rank"].alias("rank"), off.alias("residual"), c.alias("own"))

    return F.array_sort(F.transform(readings, scored))


def is_unique(best: Column, following: Column, alike: float = ALIKE) -> Column:
    return following.isNull() | (following["score"] - best["score"] > alike)


def resolve(records: DataFrame, common: dict[str, tuple[str, float, float]]) -> DataFrame:
    """(src, rec_id, book_id, subject, number, unit, dimension, common_unit, factor, converted, residual, status) of records with readings.
    Status: ok, not_unique (ok, but another unit fits alike or none of the subject's is certain), unknown, no_number."""
    every = units()
    ratio = F.array(*(F.lit(f / common[d][1] if d in common else None).cast("double") for _, d, f, _, _ in every))
    shift = F.array(*(F.lit(common[d][2] if d in common else None).cast("double") for _, d, _, _, _ in every))
    named = F.array(*(F.lit(common[d][0] if d in common else None).cast("string") for _, d, _, _, _ in every))
    converted = lambda n: (F.col("number") + attribute(n, "offset")) * F.get(ratio, n) - F.get(shift, n)

    rows = records.withColumn("_n", F.coalesce(F.when(F.col("number").isNotNull(), F.size("readings")), F.lit(0)))
    exact = F.filter("readings", lambda c: ~c["inexact"])
    sure = F.when(F.col("_n") == 1, F.get("readings", 0)["id"]).when((F.col("_n") > 1) & (F.size(exact) == 1), F.get(exact, 0)["id"])
    # Only dimensions of which some spelling has several readings ask for medians.
    asking = {every[c][1] for c in {i for found in _several().values() for i in found}}
    certain = rows.select("book_id", "subject", "number", sure.alias("_id")).where(F.col("_id").isNotNull() & attribute(F.col("_id"), "dimension").isin(asking))
    certain = certain.select("book_id", "subject", attribute(F.col("_id"), "dimension").alias("dimension"), _log(converted(F.col("_id"))).alias("_log"))
    anchors = certain.groupBy("book_id", "subject", "dimension").agg(F.percentile_approx("_log", 0.5, 10000).alias("_anchor"), F.count("*").alias("_n"))
    anchors = anchors.groupBy("book_id", "subject").agg(F.max_by(F.struct("dimension", "_anchor"), F.struct("_n", "dimension")).alias("_identity"))

    several = rows.where("_n > 1").join(anchors, ["book_id", "subject"], "left")
    options = F.transform("readings", lambda c: F.struct(c["inexact"].alias("inexact"), attribute(c["id"], "rank").alias("rank"), c["id"].alias("id")))
    off = lambda c: F.when(attribute(c["id"], "dimension") == F.col("_identity.dimension"), F.abs(_log(converted(c["id"])) - F.col("_identity._anchor")))
    several = several.withColumn("_scored", ranked_readings(options, off, lambda c: c["inexact"])).withColumn("_best", F.get("_scored", 0))
    columns = ["src", "rec_id", "book_id", "subject", "number"]
    several = several.select(*columns, F.col("_best.own.id").alias("_id"), F.col("_best.residual").alias("residual"), is_unique(F.col("_best"), F.get("_scored", 1)).alias("_unique"))
    plain = rows.where("_n <= 1").select(*columns, F.when(F.col("_n") == 1, F.get("readings", 0)["id"]).alias("_id"), F.lit(None).cast("double").alias("residual"), F.lit(True).alias("_unique"))
    status = F.when(F.col("number").isNull(), "no_number").when(F.col("_id").isNull(), "unknown").when(F.col("_unique"), "ok").otherwise("not_unique")
    own = F.col("_id")
    return several.unionByName(plain).select(
        *columns, attribute(own, "unit").alias("unit"), attribute(own, "dimension").alias("dimension"), F.get(named, own).alias("common_unit"), F.get(ratio, own).alias("factor"),
        converted(own).alias("converted"), F.when(F.col("residual") < _NONE, F.col("residual")).alias("residual"), status.alias("status"),
    )


def _several() -> dict[str, set[int]]:
    """The spellings that may stand for several units."""
    number = {row: i for i, row in enumerate(units())}
    found: dict[str, set[int]] = defaultdict(set)
    for key, _, unit, dimension, factor, offset, rank in spelling_rows():
        found[key].add(number[unit, dimension, factor, offset, rank])
    return {k: ids for k, ids in found.items() if len(ids) > 1}


def quantities(spec: DataFrame, table: DataFrame, unit_ref: DataFrame) -> DataFrame:
    """Every record of both tables as a number in the common unit of its dimension."""
    common = common_units(unit_ref)
    held = spellings(spec.sparkSession, set(common))
    columns = ["src", "rec_id", "book_id", "subject", "number"]
    places = [f"place_{i}" for i in range(5)]
    rows = _readings(table_records(table, sorted({row[0] for row in spelling_rows() if row[3] in common})), held, places)
    # A bracket is part of the name unless it is a unit.
    rows = rows.withColumn("subject", F.when(F.col("place_3_readings").isNotNull(), F.col("base")).otherwise(F.col("subject")))
    rows = rows.select(*columns, F.coalesce(*(f"{p}_readings" for p in places)).alias("readings"))
    specs = _readings(spec_records(spec), held, places[:2]).select(*columns, F.coalesce(*(f"{p}_readings" for p in places[:2])).alias("readings"))
    return resolve(cut(specs.unionByName(rows).distinct()), common)  # read for the certain units and for all records


def identities(spec: DataFrame) -> DataFrame:
    """(book_id, unit_text, raw_text, unit, raw_unit, n_rows, residual, runner_up, is_unique): for each book and pair of spellings, that of the unit column
    and that of the page, the units under which the value read and the number on the page agree best."""
    rows = spec.select("book_id", "value", clean_unit(F.col("unit")).alias("place_1"), "raw", "subject", "unit", "spec_id").distinct()
    said = spec_records(rows).select("rec_id", F.col("number").alias("_said"), "place_0")
    both = rows.select(F.col("spec_id").alias("rec_id"), "book_id", "value", "place_1").join(said, "rec_id").where("value is not null and value > 0 and _said > 0 and place_0 is not null and place_1 is not null")
    read = _readings(both, spellings(spec.sparkSession), ["place_0", "place_1"]).where("place_0_readings is not null and place_1_readings is not null")
    combos = F.flatten(F.transform("place_1_readings", lambda u: F.transform("place_0_readings", lambda r: F.struct(u["id"].alias("u"), r["id"].alias("r")))))
    pairs = read.select("book_id", F.lower("place_1").alias("unit_text"), F.lower("place_0").alias("raw_text"), "value", "_said", F.explode(combos).alias("_c"))
    u, r = F.col("_c.u"), F.col("_c.r")
    coherent = lambda value, n: _log((F.col(value) + attribute(n, "offset")) * attribute(n, "factor"))
    pairs = pairs.where(attribute(u, "dimension") == attribute(r, "dimension"))
    off = F.abs(coherent("value", u) - coherent("_said", r))
    means = pairs.groupBy("book_id", "unit_text", "raw_text", attribute(u, "unit").alias("unit"), attribute(r, "unit").alias("raw_unit"), (attribute(u, "rank") + attribute(r, "rank")).alias("rank")).agg(F.avg(off).alias("_mean"), F.count("*").alias("n_rows"))
    grouped = means.groupBy("book_id", "unit_text", "raw_text").agg(F.collect_list(F.struct("_mean", "rank", "unit", "raw_unit", "n_rows")).alias("_o"))  # as many as combinations
    ranked = grouped.withColumn("_s", ranked_readings(F.col("_o"), lambda c: c["_mean"]))
    best, following = F.get("_s", 0), F.get("_s", 1)
    return ranked.select("book_id", "unit_text", "raw_text", best["own"]["unit"].alias("unit"), best["own"]["raw_unit"].alias("raw_unit"), best["own"]["n_rows"].alias("n_rows"), best["residual"].alias("residual"), following["residual"].alias("runner_up"), is_unique(best, following).alias("is_unique"))


def equal_in_other_units(converted: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(rec_a, rec_b): records of one book and subject in different units whose converted values differ by at most
    `tolerance` of the larger. Units with the same factor are spellings of one unit."""
    band = -math.log(1 - tolerance)
    value = F.col("converted")
    rows = converted.where(value.isNotNull() & F.col("unit").isNotNull() & F.col("book_id").isNotNull() & F.col("subject").isNotNull())
    # The factor tells a unit from its spellings, but for temperatures, which differ by their zero.
    kind = F.when(F.col("dimension") == "temperature", F.xxhash64("unit")).otherwise(F.xxhash64(F.round(F.log10("factor"), 9)))
    # Book, subject, dimension and sign as two 64-bit hashes: keys of one size, whatever the names.
    group = ("book_id", "subject", "dimension", F.signum(value).cast("int"))
    place = F.coalesce(F.floor(F.log(F.when(value != 0, F.abs(value))) / band), F.lit(0))
    rows = cut(rows.select("rec_id", F.xxhash64(*group).alias("key"), F.xxhash64(F.lit(1), *group).alias("key_2"), kind.alias("kind"), "converted", place.alias("band")).distinct())  # both sides of the join
    names = ("rec_id", "kind", "converted")
    left = rows.select("key", "key_2", *(F.col(c).alias(f"{c}_a") for c in names), F.col("band").alias("band_a"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    right = rows.select("key", "key_2", "band", *(F.col(c).alias(f"{c}_b") for c in names))
    pairs = left.join(right, ["key", "key_2", "band"])
    # In one band each pair comes twice and is taken once; of two bands the lower one comes from the left.
    pairs = pairs.where((F.col("kind_a") != F.col("kind_b")) & (F.col("rec_id_a") != F.col("rec_id_b")) & ((F.col("band_a") != F.col("band")) | (F.col("rec_id_a") < F.col("rec_id_b"))))
    larger = F.greatest(F.abs("converted_a"), F.abs("converted_b"))
    close = F.abs(F.col("converted_a") - F.col("converted_b")) <= tolerance * larger * (1 + 1e-9)
    return pairs.where(close).select(F.least("rec_id_a", "rec_id_b").alias("rec_a"), F.greatest("rec_id_a", "rec_id_b").alias("rec_b")).distinct()


def solve_units(df: DataFrame, source: str, columns: dict[str, list[tuple[str, float]]], exponents: dict[str, int], tolerance: float = 0.01) -> DataFrame:
    """(source, unit_<column>..., residual, runner_up, n_rows, is_unique): for each source the units of its columns under the identity that the
    product of the columns, each to its exponent, is 1 in coherent units; mass = density x volume is {mass: 1, density: -1, volume: -1}.

    `columns` gives each column's possible units with their factors. The mean absolute log10 residual over the rows is taken for every
    combination, of which there are as many as the product of the lists, whatever the data. A solution is not unique if another combination is within
    `tolerance` of it; combinations that shift nothing (such as g and mL for kg and L) always are. Rows with a null or
    a value that isn't positive are left out; a source without others has no row."""
    logs = [F.log10(F.when(F.col(c) > 0, F.col(c))) * exponents[c] for c in columns]
    rows = df.select(F.col(source).alias("_source"), sum(logs[1:], logs[0]).alias("_sum")).where(F.col("_sum").isNotNull())
    combinations: list[tuple[float, list[str]]] = [(0.0, [])]
    for c, units in columns.items():
        combinations = [(shift + exponents[c] * math.log10(f), [*names, u]) for shift, names in combinations for u, f in units]
    shifts = sorted({round(shift, 12) for shift, _ in combinations})
    means = rows.groupBy("_source").agg(F.count("*").alias("n_rows"), F.array(*(F.avg(F.abs(F.col("_sum") + s)) for s in shifts)).alias("_means"))
    options = F.array(*(F.struct(F.get("_means", shifts.index(round(shift, 12))).alias("mean"), F.lit(i).alias("rank"), F.array(*map(F.lit, names)).alias("units")) for i, (shift, names) in enumerate(combinations)))
    ranked = means.select("_source", "n_rows", ranked_readings(options, lambda c: c["mean"]).alias("_o"))
    best, second = F.get("_o", 0), F.get("_o", 1)
    return ranked.select(
        F.col("_source").alias(source), *(F.get(best["own"]["units"], i).alias(f"unit_{c}") for i, c in enumerate(columns)), best["residual"].alias("residual"), second["residual"].alias("runner_up"), "n_rows",
        is_unique(best, second, tolerance).alias("is_unique"),
    )
