import base64
import hashlib
import uuid
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from winfleet.functions import keys, settings, text, times
from winfleet.functions.digest import spec_digest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_time_text_round_trip(spark):
    moment = F.to_timestamp(F.lit("2024-02-29 23:59:59.1239"))
    row = one(spark, times.format_time(moment), times.parse_time(F.lit("2024-02-29T23:59:59.123Z")), times.hour_bucket(moment))
    assert tuple(row) == ("2024-02-29T23:59:59.123Z", 1709251199123, "2024-02-29--23")
    assert one(spark, times.time_from_millis(F.lit(0)).cast("string"))[0] == "1970-01-01 00:00:00"


def test_seconds_since_truncates_and_reads_null_as_epoch(spark):
    now = F.lit("1970-01-01 00:01:01.999").cast("timestamp")
    row = one(
        spark,
        times.seconds_since(F.lit(None).cast("timestamp"), now),
        times.seconds_since(F.lit("1970-01-01 00:01:00").cast("timestamp_ntz"), now),
    )
    assert tuple(row) == (61, 1)


def test_uuid_keys(spark):
    numbers = [0, 31, 2**48 + 5, 2**63 - 1]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n bigint").select(keys.uuid_key(F.col("n"))).collect()]
    assert got == [str(uuid.UUID(int=n)) for n in numbers]


def test_ids_repeat_or_do_not(spark):
    ids = spark.range(100).select(keys.repeatable_id(F.col("id")).alias("a"), keys.random_id().alias("b"))
    first, second = ids.collect(), ids.collect()
    assert [r.a for r in first] == [r.a for r in second]
    assert len({r.a for r in first}) == len({r.b for r in first}) == 100
    assert all(len(r.a) == 36 and uuid.UUID(r.a) for r in first)


def test_lines_keep_places_of_missing_values(spark):
    moment, none = F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.lit(None).cast("string")
    value = F.lit(Decimal("20.50"))
    row = one(
        spark,
        text.sensor_line(moment, F.lit("e"), F.lit("k"), value),
        text.sensor_line(moment, none, F.lit("k"), value),
        text.sensor_display(moment, none, F.lit("k"), value),
        text.window_line(moment, F.lit("k"), value),
        text.window_display(moment, F.lit("k"), value),
    )
    stamp = "2024-01-01T00:00:00.000Z"
    assert tuple(row) == (
        f"{stamp},e,k,20.50",
        f"{stamp},,k,20.50",
        f"{stamp}, null, k, 20.50",
        f"{stamp},k,20.50",
        f"{stamp}, k, 20.50",
    )


def test_digest_ignores_null_fields_and_null_structs_have_none(spark):
    frame = spark.createDataFrame([(("x", None),), ((None, None),), (None,)], "s struct<a:string,b:int>")
    got = [r[0] for r in frame.select(spec_digest(F.col("s"))).collect()]
    expected = [base64.b64encode(hashlib.md5(t).digest()).decode() for t in (b'{"a":"x"}', b"{}")]
    assert got == [*expected, ""]


def test_blank_texts_and_flags(spark):
    notes = F.create_map(
        F.lit("d.org/requested-action"), F.lit("stop"), F.lit("d.org/should-restart"), F.lit("tRuE"),
        F.lit("d.org/delete-resources"), F.lit("yes"), F.lit("d.org/action-timestamp"), F.lit("17"),
    )
    row = one(
        spark,
        settings.requested_action(notes, "d.org"),
        settings.requested_action(notes),
        settings.flag(notes, settings.SHOULD_RESTART, "d.org"),
        settings.flag(notes, settings.DELETE_RESOURCES, "d.org"),
        settings.flag(notes, settings.WITHOUT_SAVEPOINT, "d.org"),
        settings.flag(F.lit(None).cast("map<string,string>"), settings.SHOULD_RESTART),
        settings.action_millis(notes, "d.org"),
        settings.or_default_if_blank(F.lit(" \t\n"), "d"),
        settings.or_default_if_blank(F.lit(None).cast("string"), "d"),
        settings.or_default(F.lit(""), "d"),
    )
    assert tuple(row) == ("STOP", "NONE", True, False, False, False, 17, "d", "d", "")


def test_types_of_times(spark):
    assert one(spark, times.time_from_millis(F.lit(1000)))[0] == datetime.fromtimestamp(1)
