"""Wide tables and the readers of untidy values."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.values import to_bigint, to_boolean, to_instant, to_text
from loomgraph.operators.wide import wide_table


@pytest.mark.parametrize(
    ("text", "value"),
    [("12", 12), (" +7\t", 7), ("-3", -3), ("009", 9), ("1,234,567", 1234567), ("1_100", 1100), ("33 237", 33237), ("33 237", 33237), ("6768.00", 6768), ("233e2", 23300), ("1.5e1", 15), ("0x1F", 31), ("9223372036854775807", 2**63 - 1),
     ("9223372036854775808", None), ("1,23", None), ("5/2", None), ("2x", None), ("about 1", None), ("NaN", None), ("", None), ("1.5", None), ("15e-1", None), ("-", None), (None, None)],
)
def test_bigint(spark, text, value):
    assert spark.createDataFrame([(text,)], "x string").select(to_bigint(F.col("x"))).first()[0] == value


def test_instants(spark):
    same = ["2024-02-21T07:28:27+02:00", "2024-02-21 05:28:27+00:00", "2024-02-21T05:28:27Z", "2024-02-21T05:28:27.000Z", " 2024-02-20T19:28:27-1000", "2024-02-21T11:13:27+0545"]
    none = ["2023-02-30T00:00:00Z", "2024-02-21T07:28:27", "yesterday", "2023-06-", "", "2024-02-21T25:00:00Z", "2024-13-01T00:00:00Z", "2024-02-21T05:28:27+99:00"]
    rows = spark.createDataFrame([(x,) for x in same + none], "x string").select("x", to_instant(F.col("x")).alias("v")).collect()
    got = {r["x"]: r["v"] for r in rows}
    assert len({got[x] for x in same}) == 1 and got[same[0]] == 1708493307000000
    assert all(got[x] is None for x in none)


def test_booleans_and_texts(spark):
    df = spark.createDataFrame([(x,) for x in ("TRUE", "no", " 1 ", "0", "maybe", "2", "", None)], "x string")
    assert [r[0] for r in df.select(to_boolean(F.col("x"))).collect()] == [1, 0, 1, 0, None, None, None, None]
    assert [r[0] for r in spark.createDataFrame([(" a b\t",), ("\u00a0",), (None,)], "x string").select(to_text(F.col("x"))).collect()] == ["a b", None, None]


ATTRIBUTES = {"n": "bigint", "t": "timestamp", "b": "boolean", "name": "string", "s": "string"}


def test_wide(spark):
    rows = [("e1", "n", "5"), ("e1", "n", " 5.0"), ("e1", "name", "x"), ("e1", "s", "own"), ("e2", "n", "5"), ("e2", "n", "6"), ("e2", "b", "yes"), ("e2", "b", "1"), ("e3", "n", "5"), ("e3", "n", ""), ("e4", "n", None), ("e4", "name", "a"), ("e4", "name", "b"),
            ("e5", "t", "2024-02-21T05:28:27Z"), ("e5", "t", "2024-02-21T07:28:27+02:00"), (None, "n", "1"), ("e6", "other", "1")]
    df = wide_table(spark.createDataFrame([(*r, "extra") for r in rows], "s string, p string, o string, uncertain string"), ATTRIBUTES)
    assert df.columns == ["s", "n", "t", "b", "name", "s_value", "uncertain"]
    got = {r["s"]: r for r in df.collect()}
    assert set(got) == {"e1", "e2", "e3", "e4", "e5"}
    assert got["e1"]["n"] == 5 and got["e1"]["name"] == "x" and got["e1"]["s_value"] == "own" and got["e1"]["uncertain"] == []
    assert got["e2"]["n"] is None and got["e2"]["b"] is True and got["e2"]["uncertain"] == ["n"]
    assert got["e3"]["uncertain"] == ["n"] and got["e4"]["uncertain"] == ["name"] and got["e4"]["n"] is None
    assert got["e5"]["t"] is not None and got["e5"]["uncertain"] == []


def test_wide_of_nothing_and_of_a_hot_entity(spark):
    schema = "s string, p string, o string"
    assert wide_table(spark.createDataFrame([], schema), ATTRIBUTES).count() == 0
    hot = spark.range(20_000).select(F.lit("hot").alias("s"), F.lit("n").alias("p"), F.lit("7").alias("o"))
    assert [tuple(r)[:2] for r in wide_table(hot, {"n": "bigint"}).collect()] == [("hot", 7)]
    with pytest.raises(ValueError):
        wide_table(hot, {"n": "date"})
