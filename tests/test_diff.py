from pyspark.sql import functions as F

from winfleet.functions.digest import spec_digest
from winfleet.operators.diff import CLUSTER_COMPONENTS, component_changes, digest_changed, must_recreate, spec_diff


def test_spec_diff(spark, rows_of):
    schema = "id string, spec struct<image:string,args:array<string>>, low int"
    declared = spark.createDataFrame(
        [("same", ("i", ["a"]), 1), ("spec", ("i", ["a"]), 1), ("limit", ("i", None), None), ("nulls", None, None), ("new", None, 1)],
        schema,
    )
    deployed = spark.createDataFrame(
        [("same", ("i", ["a"]), 1), ("spec", ("i", ["b"]), 1), ("limit", ("i", None), 1), ("nulls", None, None), ("old", None, 1)],
        schema,
    )
    got = rows_of(spec_diff(declared, deployed, ["id"], ["spec"], ["low"]))
    assert got == [("limit", "UPDATE"), ("new", "CREATE"), ("nulls", "NONE"), ("old", "DELETE"), ("same", "NONE"), ("spec", "UPDATE")]


def test_order_of_map_entries_is_no_change(spark, rows_of):
    make = lambda text: spark.sql(f"SELECT 1 AS id, named_struct('notes', {text}, 'list', array(named_struct('m', {text}))) AS spec")
    left, right = make("map('a', 'x', 'b', 'y')"), make("map('b', 'y', 'a', 'x')")
    assert rows_of(spec_diff(left, right, ["id"], ["spec"])) == [(1, "NONE")]
    assert rows_of(spec_diff(left, make("map('a', 'y', 'b', 'x')"), ["id"], ["spec"])) == [(1, "UPDATE")]
    assert rows_of(spec_diff(left, make("CAST(NULL AS map<string,string>)"), ["id"], ["spec"])) == [(1, "UPDATE")]


def test_a_value_moving_between_columns_is_a_change(spark, rows_of):
    left = spark.createDataFrame([(1, "x", None)], "id int, a string, b string")
    right = spark.createDataFrame([(1, None, "x")], "id int, a string, b string")
    assert rows_of(spec_diff(left, right, ["id"], ["a", "b"])) == [(1, "UPDATE")]


def test_changed_components_in_order(spark):
    frame = spark.createDataFrame([(("j",), ("t",), ("r",))], "j struct<v:string>, t struct<v:string>, r struct<v:string>")
    current = dict(zip(CLUSTER_COMPONENTS, [F.col("j"), F.col("t"), F.col("r")]))
    same = {name: spec_digest(spec) for name, spec in current.items()}
    nothing = frame.select(component_changes(current, same).alias("c"))
    assert nothing.first().c == [] and not nothing.select(must_recreate(F.col("c"))).first()[0]
    for name in CLUSTER_COMPONENTS:
        changed = frame.select(component_changes(current, {**same, name: F.lit("0")}).alias("c"))
        assert changed.first().c == [name] and changed.select(must_recreate(F.col("c"))).first()[0]
    missing = {name: F.lit(None).cast("string") for name in CLUSTER_COMPONENTS}
    assert frame.select(component_changes(current, missing)).first()[0] == list(CLUSTER_COMPONENTS)


def test_missing_digest_is_a_change(spark):
    spec = F.struct(F.lit(1).alias("a"))
    row = spark.range(1).select(
        digest_changed(F.lit(None).cast("string"), spec), digest_changed(F.lit("x"), spec), digest_changed(spec_digest(spec), spec)
    ).first()
    assert tuple(row) == (True, True, False)
