"""Registry rows that repeat."""

from loam.operators import registry


def test_the_least_row_of_a_key_is_inserted(spark, rows):
    existing = spark.createDataFrame([("a", 1)], "name string, n int")
    incoming = spark.createDataFrame([("a", 5, "z"), ("b", 3, "x"), ("b", 2, "y"), ("b", 2, "w"), ("c", None, None), ("c", None, None)], "name string, n int, note string")
    assert rows(registry.insert_missing(existing, incoming, ["name"])) == [("b", 2, "w"), ("c", None, None)]
    assert rows(registry.insert_missing(existing, incoming, ["name"], ["note"])) == [("b", 2, "w"), ("c", None, None)]
    assert rows(registry.insert_missing(existing, incoming.select("name"), ["name"])) == [("b",), ("c",)]
    assert registry.insert_missing(existing, incoming, ["name"]).columns == ["name", "n", "note"]
