"""Quantities: parsing, unit resolution and pairs against brute force."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from docloom.operators.units import equal_in_other_units, identities, parse_number, quantities, solve_units, spelling_rows

SPEC = "spec_id string, book_id string, subject string, unit string, value double, raw string, section string, extra string"
ROW = "book_id string, id string, parameter string, value string, unit string, row_data string, row_index int"
REF = [("pressure", "kPa"), ("force", "kN"), ("temperature", "K"), ("mass", "kg"), ("length", "mm"), ("power", "kW"), ("rotation", "rpm"), ("time", "s"), ("frequency", "Hz"), ("volume", "L")]


@pytest.mark.parametrize(
    "text,number,rest",
    [("5", 5, None), ("1,330 kg", 1330, "kg"), ("6 390", 6390, None), ("9 734lbf", 9734, "lbf"), ("1,33 m", 1.33, "m"), ("3.882e0", 3.882, None), ("1.92 x 10^2 psi", 192, "psi"),
     ("8.5·10^-1 MW", 0.85, "MW"), ("−12.5 °C", -12.5, "°C"), ("6.172E+04 Hz", 61720, "Hz"), ("tbd", None, None), ("-", None, None), ("see note 4", None, None), ("", None, None), (None, None, None)],
)
def test_parse_number(spark, text, number, rest):
    got = spark.createDataFrame([(text,)], "t string").select(parse_number(F.col("t")).alias("p")).first().p
    assert got.number == (pytest.approx(number) if number is not None else None) and (got.rest or None) == rest


def frames(spark, specs, rows):
    return spark.createDataFrame(specs, SPEC), spark.createDataFrame(rows, ROW), spark.createDataFrame(REF, "dimension string, common_unit string")


def test_cases(spark):
    specs = [
        ("s1", "b", "Tank Mass", "kg", 1.0, "tank mass was 12.5 kg", None, None),
        ("s1", "b", "Tank Mass", "kg", 1.0, "tank mass was 12.5 kg", None, None),
        ("s2", "b", "tank mass", None, 3.0, "tank mass 3", None, None),
        ("s3", "b", "draw", "mw", 1.5, None, None, None),
        ("s4", "b", "lonely", "mw", 1.5, None, None, None),
        ("s5", "b", None, None, None, None, None, None),
        ("s6", None, "x", "floops", 2.0, "x 2 floops", None, None),
    ]
    rows = [
        ("b", "t1", "TANK MASS [g]", "12480", None, '{"Parameter": "TANK MASS [g]", "Value": "12480"}', 0),
        ("b", "t2", "draw", None, None, '{"Parameter": "draw", "Value (kW)": "1,500"}', 1),
        ("b", "t3", "gap", "n/a", "mm", "{}", 2),
        ("b", "t4", "gap (upper)", "5 mm", "", None, 3),
        ("b", "t5", "flow", "", "", '{"Parameter": "flow", "Value in °C": "20"}', 4),
    ]
    got = {r.rec_id: r for r in quantities(*frames(spark, specs, rows)).collect()}
    assert len(got) == 11
    assert got["s1"].converted == pytest.approx(12.5) and got["s1"].status == "ok"
    assert got["s2"].status == "unknown" and got["s6"].status == "unknown" and got["s5"].status == "no_number" and got["t3"].status == "no_number"
    assert got["s3"].unit == "MW" and got["s3"].converted == pytest.approx(1500) and got["s3"].status == "ok"
    assert got["s4"].unit == "MW" and got["s4"].status == "not_unique"
    assert got["t1"].subject == "tank mass" and got["t1"].converted == pytest.approx(12.48)
    assert got["t4"].subject == "gap (upper)" and got["t4"].converted == pytest.approx(5)
    assert got["t5"].converted == pytest.approx(293.15)


def test_pairs_against_brute_force(spark):
    units = {"kg": 1.0, "g": 1e-3, "lb": 0.45359237, "t": 1000.0}
    specs = []
    for i in range(240):
        u = list(units)[i % 4]
        value = (10 + (i * 7 % 23) / 20) / units[u] if i % 11 else 0.0
        specs.append((f"s{i:03d}", f"b{i % 3}", f"mass {i % 5}", u, value, None, None, None))
    converted = quantities(*frames(spark, specs, [])).cache()
    got = {tuple(r) for r in equal_in_other_units(converted).collect()}
    rows = converted.collect()
    want = set()
    for a, b in itertools.combinations(sorted(rows, key=lambda r: r.rec_id), 2):
        if (a.book_id, a.subject) == (b.book_id, b.subject) and a.unit != b.unit and abs(a.converted - b.converted) <= 0.01 * max(abs(a.converted), abs(b.converted)) * (1 + 1e-9):
            want.add((a.rec_id, b.rec_id))
    assert got == want and want


def test_empty_tables(spark):
    converted = quantities(*frames(spark, [], []))
    assert converted.count() == 0 and equal_in_other_units(converted).count() == 0


def test_spellings_of_one_unit_are_no_pair(spark):
    specs = [("a", "b", "p", "psi", 5.0, "p 5 psi", None, None), ("c", "b", "p", "lbf/in2", 5.0, "p 5 lbf/in2", None, None), ("d", "b", "p", "kPa", 34.47, "p 34.47 kPa", None, None)]
    got = {tuple(r) for r in equal_in_other_units(quantities(*frames(spark, specs, []))).collect()}
    assert got == {("a", "d"), ("c", "d")}


def test_every_spelling_has_one_factor_per_unit():
    seen = {}
    for _, _, unit, dimension, factor, offset, _ in spelling_rows():
        assert seen.setdefault(unit, (dimension, offset)) == (dimension, offset) and factor > 0


def test_solve_units(spark):
    rows = [("s1", d / 1000, 1000 * v, d * v) for d, v in ((800, 1.5), (1000, 0.2), (7850, 0.01))]  # g/cm3, L, kg
    rows += [("s2", 1.0, 1.0, 1.0), ("s3", -1.0, None, 2.0)]
    df = spark.createDataFrame(rows, "source string, density double, volume double, mass double")
    columns = {"mass": [("kg", 1.0), ("g", 1e-3), ("lb", 0.45359237)], "density": [("kg/m3", 1.0), ("g/cm3", 1000.0)], "volume": [("m3", 1.0), ("L", 1e-3), ("ft3", 0.0283168)]}
    got = {r.source: r for r in solve_units(df, "source", columns, {"mass": 1, "density": -1, "volume": -1}).collect()}
    assert set(got) == {"s1", "s2"}
    assert got["s1"].residual < 1e-9 and got["s1"].n_rows == 3
    # kg with g/cm3 and L fits exactly, and so does kg with kg/m3 and m3: the solution is flagged.
    assert not got["s1"].is_unique
    narrow = {"mass": [("kg", 1.0), ("lb", 0.45359237)], "density": [("g/cm3", 1000.0)], "volume": [("m3", 1.0), ("L", 1e-3)]}
    one = solve_units(df, "source", narrow, {"mass": 1, "density": -1, "volume": -1}).where("source = 's1'").first()
    assert (one.unit_mass, one.unit_volume, one.is_unique) == ("kg", "L", True) and math.isclose(one.residual, 0, abs_tol=1e-9)


def test_identities_and_wrong_case(spark):
    specs = [(f"s{i}", "b", f"draw {i}", "mhz", 2.0 + i, f"draw {i} of {2 + i} MHz", None, None) for i in range(5)] + [("t", "b", "flow", "mw", 3.0, "flow 3 mw", None, None), ("u", "b", "x", None, None, None, None, None)]
    got = {(r.unit_text, r.raw_text): (r.unit, r.raw_unit, r.n_rows, r.is_unique) for r in identities(spark.createDataFrame(specs, SPEC)).collect()}
    assert got[("mhz", "mhz")][2] == 5 and got[("mw", "mw")] == ("MW", "MW", 1, False)
    # An exact spelling gives way to another case only where that fits.
    specs = [("a", "b", "power", "kW", 1500.0, None, None, None), ("c", "b", "power", "kW", 1500.0, None, None, None), ("d", "b", "power", "mW", 1.5, None, None, None), ("e", "b", "far", "kW", 20.0, None, None, None), ("f", "b", "far", "kW", 20.0, None, None, None), ("g", "b", "far", "MW", 20000.0, None, None, None)]
    units = {r.rec_id: r.unit for r in quantities(*frames(spark, specs, [])).collect()}
    assert units["d"] == "MW" and units["g"] == "MW"
    assert identities(spark.createDataFrame([], SPEC)).count() == 0
