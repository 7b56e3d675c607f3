import calendar
import re
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from usagemill.operators import clocks
from usagemill.operators.clocks import ABBREVIATIONS, mixture, normalise

EPOCH = datetime(1970, 1, 1)
MON = {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m}


def micros(dt, frac):
    d = dt - EPOCH
    return (d.days * 86400 + d.seconds) * 10**6 + int((frac or "")[:6].ljust(6, "0"))


def brute(text, zone):
    """A plain reading of one value, for the forms the tables have."""
    t = (text or "").strip(" ")
    m = re.fullmatch(r"(\d{4})[-/](\d\d)[-/](\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d+))? ?([zZ]|[+-]\d\d:?\d\d|[A-Z]{2,5})?(?:\[(.+)\])?", t)
    fields = None
    if m:
        fields, frac, mark, named = [int(x) for x in m.groups()[:6]], m[7], m[8], m[9]
    m = re.fullmatch(r"[A-Z][a-z]{2}, (\d\d) ([A-Z][a-z]{2}) (\d{4}) (\d\d):(\d\d):(\d\d) ([+-]\d{4})", t)
    if m:
        fields, frac, mark, named = [int(m[3]), MON[m[2].lower()], int(m[1]), int(m[4]), int(m[5]), int(m[6])], None, m[7], None
    m = re.fullmatch(r"([A-Z][a-z]{2}) (\d\d?), (\d{4}) (\d\d?):(\d\d):(\d\d) ([AP])M", t)
    if m:
        fields, frac, mark, named = [int(m[3]), MON[m[1].lower()], int(m[2]), int(m[4]) % 12 + (12 if m[7] == "P" else 0), int(m[5]), int(m[6])], None, None, None
    if fields:
        try:
            wall = datetime(*fields)
        except ValueError:
            return "invalid", -1
        if mark:
            if mark[0] in "+-":
                d = mark.replace(":", "")
                off = (int(d[1:3]) * 60 + int(d[3:5])) * (-1 if d[0] == "-" else 1)
            else:
                off = ABBREVIATIONS[mark.upper()] * 60
            return "ok", micros(wall - timedelta(minutes=off), frac)
        zone = named or zone
        if zone is None:
            return "no_zone", -1
        z = ZoneInfo(zone)
        us = set()
        for fold in (0, 1):
            utc = wall.replace(tzinfo=z, fold=fold).astimezone(timezone.utc)
            if utc.astimezone(z).replace(tzinfo=None) == wall:
                us.add(utc.replace(tzinfo=None))
        return ("ok", micros(us.pop(), frac)) if len(us) == 1 else ("ambiguous" if us else "nonexistent", -1)
    m = re.fullmatch(r"\[(\d+), ?(\d+)\]", t)
    if m:
        return "ok", int(m[1]) * 10**6 + int(m[2]) // 1000
    try:
        n = Decimal(t)
        for k in (1, 10**3, 10**6, 10**9):
            if 946684800 * k <= n < 4102444800 * k:
                return "ok", int(n * 10**6 // k)
    except ArithmeticError:
        pass
    return "invalid", -1


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "record_id bigint, source string, text string, zone string")
    return [(r.status, r.utc_us) for r in normalise(df, F.col("record_id"), F.col("source"), F.col("text"), F.col("zone"), **kw).orderBy("record_id").collect()]


CASES = [
    ("2025-03-30 02:30:00", "Europe/Berlin"), ("2025-10-26 02:30:00.25", "Europe/Berlin"), ("2025-10-26 03:00:00", "Europe/Berlin"), ("2025-03-30 03:00:00", "Europe/Berlin"),
    ("2025-04-06 01:45:00", "Australia/Lord_Howe"), ("2025-10-05 02:15:00", "Australia/Lord_Howe"), ("2025-11-02 01:30:00", "America/New_York"), ("2025-06-01 00:00:00", None),
    ("2025-10-26 02:30:00 CEST", "Europe/Berlin"), ("2025-10-26T02:30:00+01:00[Europe/Paris]", None), ("2025-06-01t00:00:00.123456789z", None), ("2025/06/01 12:00:00", "UTC"),
    ("Mon, 09 Mar 2026 01:03:03 +0545", None), ("Mar 12, 2024 12:51:12 AM", "Asia/Tokyo"), ("Mar 12, 2024 12:51:12 PM", "Asia/Tokyo"), (" 1729984294291 ", None), ("1.760775548897E12", None),
    ("1753950257.6000009", None), ("1717397534057221028", None), ("1710650795918871", None), ("[1752241841, 9]", None), ("[1752241841,999999999]", None), ("2025-02-29T00:00:00Z", None),
    ("1/23/2025 10:00:00", "UTC"), ("23.1.2025 10:00", "UTC"), ("9 Mar 2025 10:00:00", "UTC"), ("March 9, 2025 10:00:00", "UTC"), ("2025-06-01 00:00\x1f:00", "UTC"),
    ("2025-11-04T25:10:00Z", None), ("NaN", None), ("", None), (None, "UTC"), ("[]", None), ("-1", None), ("12", None), ("2024-02-29 00:00:00", "Asia/Kathmandu"),
]


def test_readings_against_a_plain_reader(spark):
    got = run(spark, [("a", t, z) for t, z in CASES])
    more = {"1/23/2025 10:00:00": (2025, 1, 23), "23.1.2025 10:00": (2025, 1, 23), "9 Mar 2025 10:00:00": (2025, 3, 9), "March 9, 2025 10:00:00": (2025, 3, 9)}
    for (t, z), g in zip(CASES, got):
        assert g == (("ok", micros(datetime(*more[t], 10), None)) if t in more else brute(t, z)), (t, z)


def test_on_the_tables(spark, data):
    df = spark.read.parquet(f"{data}/agent_clock.parquet")
    text = F.coalesce("timestamp", "session.ts", "trace.endTime", "loader.started_at")
    rows = df.select("record_id", text.alias("t"), "host_zone").collect()
    got = {r.record_id: (r.status, r.utc_us) for r in normalise(df, F.col("record_id"), F.col("agent"), text, F.col("host_zone")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.record_id] == brute(r.t, r.host_zone), (r.t, r.host_zone)


def test_mixture_settles_day_and_month_per_source(spark):
    british = [("uk", f"{d:02d}/03/2025 10:00:00", "UTC") for d in range(1, 29)]
    american = [("us", f"03/{d:02d}/2025 10:00:00", "UTC") for d in range(1, 29)]
    even = [("odd", "03/04/2025 10:00:00", "UTC")]
    got = run(spark, british + american + even)
    want = [("ok", micros(datetime(2025, 3, d, 10), None)) for d in range(1, 29)]
    assert got[:28] == want and got[28:56] == want
    assert got[56] == ("undecided", -1)
    assert run(spark, [("odd", "05/05/2025 10:00:00", "UTC")]) == [("ok", micros(datetime(2025, 5, 5, 10), None))]
    assert run(spark, even, min_posterior=0.4)[0][0] == "ok"


def test_em_weights():
    both = (("dmy", 1), ("mdy", 2))
    w, share = mixture([(both, 10), ((("dmy", 1),), 20), ((("mdy", 2),), 0)])
    assert w["dmy"] > 0.999 and share[1] > 0.9


def test_months_at_work_are_evidence(spark):
    """Both formats are as common, but the source was at work in March and April only."""
    sure = [("s", f"{d}/03/2025 10:00:00", "UTC") for d in range(13, 29)] + [("s", f"04/{d}/2025 10:00:00", "UTC") for d in range(13, 29)]
    open_ = [("s", "09/03/2025 10:00:00", "UTC"), ("s", "04/09/2025 10:00:00", "UTC"), ("s", "03/04/2025 10:00:00", "UTC")]
    got = run(spark, sure + open_, min_posterior=0.8)
    assert got[-3] == ("ok", micros(datetime(2025, 3, 9, 10), None)) and got[-2] == ("ok", micros(datetime(2025, 4, 9, 10), None))
    assert got[-1] == ("undecided", -1)


def test_unknown_zone_empty_table_and_repeats(spark):
    assert run(spark, [("a", "2025-06-01 00:00:00", "somewhere"), ("a", "2025-06-01 00:00:00", "UTC"), ("a", "2025-06-01 00:00:00", "UTC"), (None, "1752241841", None)])[0] == ("no_zone", -1)
    assert run(spark, []) == []
    assert clocks.normalise(spark.createDataFrame([(1, "x" * 200_000)], "record_id bigint, t string"), F.col("record_id"), F.lit("a"), F.col("t"), F.lit(None).cast("string")).first().status == "invalid"
