"""Values packed in one field."""

import pytest
from pyspark.sql import functions as F

from folioframe.operators.packed import NAMES, TERMS, packed_items, split_packed

NAME_CASES = [
    ("Doe, Jane and Roe, Richard", ["Doe, Jane", "Roe, Richard"]),
    ("Jane Doe, Richard Roe & Ann Poe", ["Jane Doe", "Richard Roe", "Ann Poe"]),
    ("Doe, J. M., Roe, R., de la Poe, A.", ["Doe, J. M.", "Roe, R.", "de la Poe, A."]),
    ('"Doe, Jane","Richard Roe"; "Poe, A."', ["Doe, Jane", "Richard Roe", "Poe, A."]),
    ("'Doe, Jane', 'Roe, R.'", ["Doe, Jane", "Roe, R."]),
    ("Doe, Jane and {Department of Trade and Industry, Town} and others", ["Doe, Jane", "Department of Trade and Industry, Town"]),
    ("Institute for Music and Theatre, Town; Doe, Jane; et al.", ["Institute for Music and Theatre, Town", "Doe, Jane"]),
    ("Music and Theatre, Institute for (Town)", ["Music and Theatre, Institute for (Town)"]),
    ("Doe, Jane;;  ; Roe,\tRichard ;", ["Doe, Jane", "Roe, Richard"]),
    ("Doe,  Jane", ["Doe, Jane"]),
    ("O'Neil, Ann | The Nat'l Comm. on Examples, Town", ["O'Neil, Ann", "The Nat'l Comm. on Examples, Town"]),
    ("Doe, Jane\r\nRoe, Richard", ["Doe, Jane", "Roe, Richard"]),
    ("Doe J, Roe RB, Poe A", ["Doe J", "Roe RB", "Poe A"]),
    ('Doe, "Jane', ["Doe, Jane"]),
    ("", []),
    ("   ", []),
    (None, None),
]
TERM_CASES = [
    ("trees; rings; Town, 1900", ["trees", "rings", "Town, 1900"]),
    ("trees, rings, Town, 1900", ["trees", "rings", "Town, 1900"]),
    ('trees, "Town, 1900", rings', ["trees", "Town, 1900", "rings"]),
    ("trees / rings", ["trees", "rings"]),
    ("trees|rings", ["trees", "rings"]),
    ("trees\nrings", ["trees", "rings"]),
    ("Talk given in Town in 1900", ["Talk given in Town in 1900"]),
]


@pytest.mark.parametrize("kind,cases", [(NAMES, NAME_CASES), (TERMS, TERM_CASES)])
def test_items(spark, kind, cases):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, value string")
    got = {r.i: r["items"] for r in df.select("i", packed_items("value", kind).alias("items")).collect()}
    assert {i: got[i] for i in got} == {i: e for i, (_, e) in enumerate(cases)}


def test_positions_clashing_names_and_repeats(spark):
    df = spark.createDataFrame([(1, "a; b", "x"), (1, "a; b", "x"), (2, None, "y")], "id int, item string, item_pos string")
    out = split_packed(df, "item", TERMS, pos="p", item="v").select("id", "p", "v", "item_pos").collect()
    assert sorted(map(tuple, out)) == [(1, 1, "a", "x"), (1, 1, "a", "x"), (1, 2, "b", "x"), (1, 2, "b", "x")]


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "value string")
    assert split_packed(empty, "value").count() == 0
    long = spark.createDataFrame([("; ".join(f"Doe{i}, J." for i in range(20000)),)], "value string")
    assert split_packed(long, "value").agg(F.max("item_pos")).first()[0] == 20000


def test_no_shuffle(spark):
    df = spark.createDataFrame([("a; b",)], "value string")
    assert "Exchange" not in split_packed(df, "value")._jdf.queryExecution().executedPlan().toString()
