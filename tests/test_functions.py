"""Golden cases for the scalar expressions."""

import datetime as dt

from pyspark.sql import functions as F

from slotwise.functions import clock, intents, text


def one(spark, expr, value, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("r")).first()["r"]


def test_py_strip_matches_python(spark):
    for s in ["  hi\t", "\n name ", "x", "   ", "\x1cA\x1f"]:
        assert one(spark, text.py_strip("x"), s) == s.strip()


def test_title_case_matches_python(spark):
    for s in ["mary-jane o'brien 3rd", "rahul sharma", "ÉLODIE d'arc", "a1b2"]:
        assert one(spark, text.title_case("x"), s) == s.title()


def test_fmt_day(spark):
    assert one(spark, text.fmt_day("x"), dt.date(2025, 6, 10), "x date") == "Tue, 10 Jun"


def test_parse_day_rejects_bad_dates(spark):
    assert one(spark, text.parse_day("x"), "2025-02-30") is None
    assert one(spark, text.parse_day("x"), "2025-06-01") == dt.date(2025, 6, 1)


def test_like_search_sqlite_semantics(spark):
    rows = [("Amit",), ("AMIT",), ("Émile",), ("a%b",), ("a\\b",), ("axb",)]
    df = spark.createDataFrame(rows, "x string")

    def hits(q):
        return sorted(r.x for r in df.where(text.contains_like("x", q)).collect())

    assert hits("amit") == ["AMIT", "Amit"]  # ASCII folding
    assert hits("é") == []  # non-ASCII is not folded: 'É' != 'é'
    assert hits("a%b") == ["a%b", "a\\b", "axb"]  # user % is a wildcard
    assert hits("a_b") == ["a%b", "a\\b", "axb"]
    assert hits("a\\b") == ["a\\b"]  # backslash is literal


def test_phone_normalisation(spark):
    assert one(spark, text.normalize_phone("x"), "whatsapp:+911") == "+911"
    assert one(spark, text.messaging_address("x"), "whatsapp:+911") == "whatsapp:+911"
    assert one(spark, text.messaging_address("x"), "+911") == "whatsapp:+911"


def test_numbered_list(spark):
    assert one(spark, text.numbered_list("x"), ["a", "b"], "x array<string>") == "1. a\n2. b"


def test_fallbacks(spark):
    assert one(spark, text.or_fallback("x", "Patient"), "") == "Patient"
    assert one(spark, text.or_fallback("x", "Patient"), None) == "Patient"
    assert one(spark, text.py_str("x"), None) == "None"


def test_working_day_tokens(spark):
    assert one(spark, clock.working_day_tokens("x"), " Mon, Thu,xx,sat") == ["Mon", "Thu"]


def test_minutes_round_trip(spark):
    assert one(spark, clock.hhmm_to_minutes("x"), "09:30") == 570
    assert one(spark, clock.minutes_to_hhmm(F.lit(570)), "") == "09:30"


def test_intents_and_menu_pick(spark):
    df = spark.createDataFrame(
        [(" Hi ",), ("CANCEL",), ("my appointment",), ("2",), ("2.5",), ("+1",), ("9",), ("0",)], "b string"
    )
    t = df.select(intents.message_text("b").alias("t"))
    got = t.select("t", intents.intent("t").alias("i"),
                   intents.menu_pick("t", F.array(F.lit("a"), F.lit("b"))).alias("p")).collect()
    assert [r.i for r in got] == ["greet", "cancel", "status", "other", "other", "other", "other", "greet"]
    assert [r.p for r in got] == [None, None, None, "b", None, "a", None, None]


def test_insert_defaults_only_for_absent_columns(spark):
    import datetime as dt

    from slotwise.schemas import with_insert_defaults

    df = spark.createDataFrame([(1, "Dr. X", "ENT", "Mon", None)],
                               "id long, name string, department string, available_days string, start_time string")
    row = with_insert_defaults(df, "doctors").first()
    assert (row.slot_duration_mins, row.start_time, row.end_time) == (15, None, "13:00")
    a = spark.createDataFrame([(1, "p", 2)], "id long, patient_phone string, doctor_id long")
    now = dt.datetime(2025, 7, 1, 9, 0)
    r = with_insert_defaults(a, "appointments", now).first()
    assert (r.status, r.created_at, r.token_number) == ("booked", now, None)
