import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import ROUND_HALF_DOWN, Decimal, localcontext

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winfleet.functions.decimals import BASE, limb_count, with_mean
from winfleet.operators.windows import average_temperature, maximum_temperature

EPOCH = datetime(1970, 1, 1)
SECOND = timedelta(seconds=1)


def sensor_frame(spark, rows, kind="decimal(8,2)"):
    """Rows of (key, seconds since the epoch, value)."""
    plain = [(str(i), EPOCH + timedelta(seconds=s), k, None if v is None else Decimal(v)) for i, (k, s, v) in enumerate(rows)]
    return spark.createDataFrame(plain, f"event_id string, event_time timestamp_ntz, location_id string, temperature {kind}")


def brute_force(rows, size, slide, merge):
    groups = defaultdict(list)
    for key, seconds, value in rows:
        start = seconds - seconds % slide
        while start > seconds - size:
            if value is not None:
                groups[key, start].append(Decimal(value))
            start -= slide
    return {(k, EPOCH + timedelta(seconds=s)): merge(v) for (k, s), v in groups.items()}


def mean(values):
    return (sum(values) / len(values)).quantize(Decimal("0.01"), ROUND_HALF_DOWN)


def as_dict(frame):
    return {(r.location_id, r.window_start): r.temperature for r in frame.collect()}


@pytest.mark.parametrize("precision", [18, 38])
@pytest.mark.parametrize("scale", [0, 1, 2, 3, 5, 12])
def test_mean_of_limbs_agrees_with_decimal(spark, precision, scale):
    source = random.Random(scale)
    cases = [(3, 2), (5, 2), (151, 1), (0, 3), (-3, 2), (-5, 2), (15, 10), (25, 10), (251, 100), (-15, 10), (-25, 10), (5 * 10**9, 10**10 // 2)]
    cases += [(source.randint(-(10**7), 10**7), source.choice([1, 2, 3, 4, 7, 8, 20, 1000])) for _ in range(1000)]
    cases += [(source.randint(-(10**17), 10**17), source.choice([1, 2, 3, 9_000_000_000])) for _ in range(200)]
    kind = T.DecimalType(precision, scale)
    names = [f"s{k}" for k in range(limb_count(kind))]
    # Sums of limbs need not be limbs: some of what a higher one could hold stays in the lowest.
    spread = [([total - (total // 7 // BASE) * BASE, total // 7 // BASE] + [0] * len(names))[: len(names)] for total, _ in cases]
    frame = spark.createDataFrame([(*limb, n, str(total)) for limb, (total, n) in zip(spread, cases)], [*names, "n", "total"])
    got = with_mean(frame, names, "n", kind, "mean").collect()
    assert len(got) == len(cases)
    for row in got:
        with localcontext(prec=60):
            exact = Decimal(int(row.total)) / 10**scale / row.n
            assert row["mean"] == exact.quantize(Decimal("0.01"), ROUND_HALF_DOWN), (row, scale)


@pytest.mark.parametrize("kind", [(1, 0), (9, 9), (10, 9), (18, 0), (18, 18), (19, 0), (19, 19), (27, 5), (28, 10), (36, 0), (37, 2), (38, 2), (38, 6), (38, 20), (38, 37), (38, 38)])
def test_averages_of_any_decimal_type(spark, kind):
    source = random.Random(sum(kind))
    precision, scale = kind
    whole = 10 ** min(precision, 36 + scale - 2)
    with localcontext(prec=100):
        values = [Decimal(source.choice([1, -1]) * source.randrange(whole if source.random() < 0.5 else min(whole, 10 ** source.randint(1, 38)))).scaleb(-scale) for _ in range(60)]
        frame = spark.createDataFrame([(str(i), EPOCH, f"k{i % 7}", v) for i, v in enumerate(values)], f"event_id string, event_time timestamp_ntz, location_id string, temperature decimal({precision},{scale})")
        got = {r.location_id: r.temperature for r in average_temperature(frame, SECOND, SECOND).collect()}
        for k in range(7):
            own = values[k::7]
            assert got[f"k{k}"] == (sum(own) / len(own)).quantize(Decimal("0.01"), ROUND_HALF_DOWN)


def test_named_rounding_cases(spark):
    cases = [("0.03", 2, "0.01"), ("0.05", 2, "0.02"), ("1.51", 1, "1.51"), ("0.00", 3, "0.00"), ("-0.03", 2, "-0.01")]
    for total, count, expected in cases:
        rows = [("k", 0, total)] + [("k", 0, "0.00")] * (count - 1)
        frame = average_temperature(sensor_frame(spark, rows), timedelta(minutes=1), timedelta(minutes=1))
        assert frame.collect()[0].temperature == Decimal(expected)


SHAPES = [(60, 10), (60, 7), (50, 20), (60, 60), (5, 10), (7, 3), (3600, 300), (1, 1)]


@pytest.mark.parametrize("size,slide", SHAPES)
def test_both_plans_agree_with_brute_force(spark, size, slide):
    source = random.Random(size * 31 + slide)
    rows = [
        (source.choice("aab"), source.randint(-500, 3000), f"{source.randint(-3000, 3000) / 100:.2f}") for _ in range(400)
    ]
    rows += [("c", 10, None), ("a", 10, None)]
    frame = sensor_frame(spark, rows)
    lengths = (timedelta(seconds=size), timedelta(seconds=slide))
    for panes in (True, False):
        assert as_dict(average_temperature(frame, *lengths, panes)) == brute_force(rows, size, slide, mean)
        assert as_dict(maximum_temperature(frame, *lengths, panes)) == brute_force(rows, size, slide, max)


@pytest.mark.parametrize("kind", ["decimal(8,2)", "decimal(18,2)", "decimal(10,1)", "decimal(20,6)", "decimal(6,0)"])
def test_decimal_types_agree(spark, kind):
    rows = [("a", s, f"{s % 17}") for s in range(0, 600, 7)]
    frame = average_temperature(sensor_frame(spark, rows, kind), 60 * SECOND, 10 * SECOND)
    assert as_dict(frame) == brute_force(rows, 60, 10, mean)
    assert frame.schema["temperature"].dataType == T.DecimalType(18, 2)


def test_large_decimals_do_not_overflow(spark):
    rows = [("a", 0, "9999999999999999.99")] * 50
    frame = average_temperature(sensor_frame(spark, rows, "decimal(18,2)"), 60 * SECOND, 10 * SECOND)
    assert {r.temperature for r in frame.collect()} == {Decimal("9999999999999999.99")}
    rows = [("a", 0, "30000000000000000.01"), ("a", 1, "30000000000000000.02")]
    frame = average_temperature(sensor_frame(spark, rows, "decimal(38,2)"), 60 * SECOND, 10 * SECOND)
    assert {r.temperature for r in frame.collect()} == {Decimal("30000000000000000.01")}


def test_windows_are_half_open(spark):
    frame = sensor_frame(spark, [("a", 59, "1.00"), ("a", 60, "2.00")])
    got = as_dict(maximum_temperature(frame, 60 * SECOND, 60 * SECOND))
    assert got == {("a", EPOCH): Decimal("1.00"), ("a", EPOCH + 60 * SECOND): Decimal("2.00")}


def test_time_zones_of_the_input_do_not_matter(spark):
    rows = [("a", s, "1.00") for s in range(0, 7200, 600)]
    plain = sensor_frame(spark, rows)
    zoned = plain.withColumn("event_time", F.col("event_time").cast("timestamp"))
    left = average_temperature(plain)
    right = average_temperature(zoned).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    assert as_dict(left) == as_dict(right)


def test_rejects_unusable_arguments(spark):
    frame = sensor_frame(spark, [("a", 0, "1.00")])
    with pytest.raises(ValueError):
        average_temperature(frame, timedelta(0), SECOND)
    with pytest.raises(TypeError):
        average_temperature(frame.withColumn("temperature", F.col("temperature").cast("double")))


def test_pane_plan_combines_before_it_moves_rows(spark):
    """Two exchanges, a partial aggregate below the first, and none between the window expansion and its aggregate."""
    frame = average_temperature(sensor_frame(spark, [("a", 0, "1.00")]))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_sum(" in plan.split("Exchange hashpartitioning")[-1]
    assert "window_start" not in plan.split("Exchange hashpartitioning")[1]


def test_sliding_maxima_are_not_expanded_before_they_are_taken(spark):
    """Work inside a task follows panes, so that its memory does not hold a row per pane and window."""
    readings = [(f"k{k % 3}", 400 * k, k % 7) for k in range(100)]
    rows = sensor_frame(spark, readings)
    frame = maximum_temperature(rows, timedelta(hours=1), timedelta(seconds=10))
    plan = frame._jdf.queryExecution().optimizedPlan().toString().splitlines()
    names = [line.strip(" :+-").split(" ")[0] for line in plan]
    assert names.count("Aggregate") == 1 and "Window" in names  # rows to panes; nothing is grouped after that
    assert as_dict(frame) == brute_force(readings, 3600, 10, max)
