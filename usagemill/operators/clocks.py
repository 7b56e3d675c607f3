"""Mixed timestamp formats and time zones, normalised to UTC microseconds.

Every reading is parsed under each format that could hold for it. Where more
than one gives a real date (day/month against month/day), the readings of one
source are taken as drawn from a mixture of formats, and from the months in
which the source was at work. A parse's likelihood is the weight of its format
times the share of the month that the value falls in if read that way; readings
with one possible parse count fully, the others by their parses' posteriors, and
expectation-maximisation settles weights and shares. A reading takes the parse
with the highest posterior, and is marked undecided when that is below
min_posterior.

All parsing is built from column expressions: a few characters tell which
pattern a text can have, and only that one is matched, once. EM runs on counts
per source and set of possible formats and months, a table whose size follows
the calendar, not the rows. Readings with one parse need no look-up in it.

Statuses
    invalid      no reading, no real date or time, no unit that gives this century
    no_zone      wall-clock text without zone or offset, and no zone known
    ambiguous    wall-clock text that occurs twice in its zone
    nonexistent  wall-clock text that never occurs in its zone
    undecided    two formats hold and neither is likely enough
    ok           utc_us is the instant; it is -1 in all other cases

Equal rows each give a row; an unknown zone name counts as no zone; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.session import cut, cut_counted

#: Hours from UTC of the usual European and US zone abbreviations. Some stand for
#: other zones elsewhere in the world (BST, CST, MST, EST); the definition of the readings rules those out.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "MET": 1, "MEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
CENTURY = (946_684_800, 4_102_444_800)
UNITS = {"epoch_s": 1, "epoch_ms": 1_000, "epoch_us": 1_000_000, "epoch_ns": 1_000_000_000}
FORMATS = ("ymd", "dmy", "mdy", "month_first", "day_first", *UNITS, "pair")
MIN_POSTERIOR = 0.9
MAX_TABLE = 500_000
#: Mean length of a month, in microseconds.
MONTH = 2_629_746_000_000
DAY = 86_400_000_000

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp][Mm]))?"
_ZONE = r" ?([Zz]|[+-]\d{2}:?\d{2}|[A-Z]{2,5})?(?:\[([A-Za-z0-9_+\-/]+)\])?"
_YMD = rf"^(\d{{4}})([-/])(\d{{2}})\2(\d{{2}})[Tt ]{_TIME}{_ZONE}\z"
_NUMERIC = rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})[Tt ,]+{_TIME}{_ZONE}\z"
_MONTH_FIRST = rf"^([A-Za-z]{{3}})[a-z]*\.? (\d{{1,2}}),? (\d{{4}})(),? {_TIME}{_ZONE}\z"
_DAY_FIRST = rf"^(?:[A-Za-z]{{3}}, )?(\d{{1,2}}) ([A-Za-z]{{3}})[a-z]* (\d{{4}})() {_TIME}{_ZONE}\z"
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,2})?\z"
_PAIR = r"^\[ *([0-9]{1,18}) *, *([0-9]{1,9}) *\]\z"


#: Pattern of each calendar shape, and which of its groups hold year, month and day. A text has one shape at most.
SHAPES = {"ymd": (_YMD, (1, 3, 4)), "numeric": (_NUMERIC, (4, 3, 1)), "month_first": (_MONTH_FIRST, (3, 1, 2)), "day_first": (_DAY_FIRST, (3, 2, 1))}
_SEP = "\x1f"


def _integer(text: Column) -> Column:
    return F.nullif(text, F.lit("")).cast("int")


def _by_shape(value) -> Column:  # noqa: ANN001
    out = None
    for name, (pattern, place) in SHAPES.items():
        test = F.col("shape") == name
        out = F.when(test, value(pattern, place)) if out is None else out.when(test, value(pattern, place))
    return out


def _possible_shape(t: Column) -> Column:
    """The one pattern that t can have by its first characters; each pattern implies its condition here."""
    at = lambda i: F.substring(t, i, 1)
    digit = lambda i: at(i).between("0", "9")
    letter = F.upper(at(1)).between("A", "Z")
    timed = t.contains(":")
    return (
        F.when(at(5).isin("-", "/") & digit(2) & digit(3), "ymd").when(letter & (at(4) == ","), "day_first").when(letter, "month_first")
        .when(timed & digit(1) & (at(2).isin("-", "/", ".") | at(3).isin("-", "/", ".")), "numeric").when(timed & digit(1) & ((at(2) == " ") | (at(3) == " ")), "day_first")
        .when(at(1) == "[", "pair").otherwise("number")
    )


def _pieces(base: DataFrame) -> DataFrame:
    """base with the parts of its text t, a few columns at a time so that nothing is worked out twice.

    wall1 and wall2 are microseconds as if in UTC, null if no real date or time:
    wall2 is the month-first reading of a numeric date. offset is in minutes.
    """
    df = base.withColumn("t", F.when(~F.col("t").contains(_SEP), F.col("t")))
    df = df.withColumn("shape", _possible_shape(F.col("t")))
    # A text that doesn't match comes back as it is, in one part.
    text = _by_shape(lambda pattern, _: F.regexp_replace("t", pattern, _SEP.join(f"${i}" for i in range(1, 12))))
    df = df.withColumns({
        "g": F.split(text, _SEP), "number": F.when((F.col("shape") == "number") & F.col("t").rlike(_NUMBER), F.expr("try_cast(t AS DECIMAL(38, 18))")),
        "pair": F.when((F.col("shape") == "pair") & F.col("t").rlike(_PAIR), F.split(F.translate("t", "[] ", ""), ",")),
    })
    df = df.withColumn("g", F.when(F.size("g") == 11, F.col("g"))).withColumn("shape", F.when(F.col("g").isNotNull(), F.col("shape")))
    df = _fenced(df.drop("t"))
    g = lambda i: F.col("g")[i - 1]
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    part = lambda k: _by_shape(lambda _, place: g(place[k]))
    number = lambda k: F.coalesce(part(k).try_cast("int"), F.try_element_at(months, F.lower(part(k))))
    known = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 60)])
    df = df.withColumns({
        "y": number(0), "mo": number(1), "d": number(2), "hh": _integer(g(5)), "mi": _integer(g(6)), "ss": F.coalesce(_integer(g(7)), F.lit(0)), "us": F.rpad(F.substring(g(8), 1, 6), 6, "0").cast("bigint"),
        "half": F.upper(g(9)), "mark": g(10), "zone": F.nullif(g(11), F.lit("")), "digits": F.when(g(10).startswith("+") | g(10).startswith("-"), F.translate(g(10), "+-:", "")).otherwise(F.when(g(10).isNotNull(), "")),
    })
    half, hh = F.col("half"), F.col("hh")
    hour = F.when(half == "", hh).when(hh.between(1, 12), hh % 12 + F.when(half == "PM", 12).otherwise(0))
    oh, om = F.substring("digits", 1, 2).try_cast("int"), F.substring("digits", 3, 2).try_cast("int")
    shift = F.when((om < 60) & (oh * 60 + om <= 18 * 60), (oh * 60 + om) * F.when(F.col("mark").startswith("-"), -1).otherwise(1))
    midnight = lambda m, d: F.unix_micros(F.try_make_timestamp(F.col("y"), m, d, F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
    df = df.withColumns({
        "hour": hour, "offset": F.when(F.col("digits") != "", shift).otherwise(F.try_element_at(known, F.upper("mark"))),
        "date1": F.when(F.col("shape").isNotNull(), midnight(F.col("mo"), F.col("d"))), "date2": F.when(F.col("shape") == "numeric", midnight(F.col("d"), F.col("mo"))),
    })
    real = F.col("hour").between(0, 23) & F.col("mi").between(0, 59) & F.col("ss").between(0, 59) & ((F.col("mark") == "") | F.col("offset").isNotNull())
    time = F.when(real, (F.col("hour") * 3600 + F.col("mi") * 60 + F.col("ss")).cast("bigint") * 1_000_000 + F.col("us"))
    df = _fenced(df.withColumn("time", time).select("record_id", "source", "host_zone", "zone", "shape", "offset", "date1", "date2", "time", "number", "pair"))
    return df.withColumns({"wall1": F.col("date1") + F.col("time"), "wall2": F.col("date2") + F.col("time")})


def _parses(df: DataFrame) -> DataFrame:
    """df with its parses: (format1, utc1, at1) and, where a date can be read both ways, (format2, utc2, at2).

    utc is null where the zone has yet to be found. No text has more than two:
    patterns exclude each other, and so do the units' ranges. Plain columns, as
    arrays and functions over them would take the projection out of code
    generation.
    """
    number = F.col("number")
    units, scaled = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for name, per_second in UNITS.items():
        inside = (number >= F.lit(CENTURY[0] * per_second)) & (number < F.lit(CENTURY[1] * per_second))
        us = number * F.lit(1_000_000 // per_second) if per_second <= 1_000_000 else number / F.lit(per_second // 1_000_000)
        units, scaled = F.when(inside, name).otherwise(units), F.when(inside, F.floor(us).cast("bigint")).otherwise(scaled)
    seconds = F.col("pair")[0].cast("bigint")
    paired = F.when((seconds >= CENTURY[0]) & (seconds < CENTURY[1]), seconds * 1_000_000 + F.expr("cast(pair[1] AS bigint) div 1000"))
    # Day and month alike: both readings are one.
    df = df.withColumns({"unit": units, "scaled": scaled, "paired": paired, "other": F.when(~F.col("wall2").eqNullSafe(F.col("wall1")), F.col("wall2"))})
    one, two = F.col("wall1").isNotNull(), F.col("other").isNotNull()
    shift = F.col("offset").cast("bigint") * 60_000_000
    format1 = F.when(one, F.when(F.col("shape") == "numeric", "dmy").otherwise(F.col("shape"))).when(two, "mdy").when(F.col("unit").isNotNull(), F.col("unit")).when(F.col("paired").isNotNull(), "pair")
    return df.withColumns({"format1": format1, "at1": F.coalesce("wall1", "other", "scaled", "paired"), "format2": F.when(one & two, "mdy"), "at2": F.when(one & two, F.col("other"))}).withColumns({
        "utc1": F.coalesce(F.when(one | two, F.col("at1") - shift), F.when(~(one | two), F.col("at1"))), "utc2": F.col("at2") - shift,
    })


def _local(us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def resolve_wall(df: DataFrame, wall: str, zone: str) -> DataFrame:
    """df with n, how many UTC instants show wall in zone, and first, the earliest of them.

    The offsets in force a day before and a day after are the only ones that can
    hold around a change, so two candidates are enough.
    """
    w, z = F.col(wall), F.col(zone)
    df = df.withColumns({"_before": _local(w - DAY, z) - (w - DAY), "_after": _local(w + DAY, z) - (w + DAY)})
    a, b = w - F.col("_before"), w - F.col("_after")
    df = df.withColumns({"_a": F.when(_local(a, z) == w, a), "_b": F.when((_local(b, z) == w) & (F.col("_before") != F.col("_after")), b)})
    count = F.col("_a").isNotNull().cast("int") + F.col("_b").isNotNull().cast("int")
    return df.withColumns({"n": F.when(w.isNotNull(), count), "first": F.least("_a", "_b")}).drop("_before", "_after", "_a", "_b")


def mixture(signatures: list[tuple[tuple[tuple[str, int], ...], int]], rounds: int = 50) -> tuple[dict[str, float], dict[int, float]]:
    """EM over (possible parses as (format, month), rows): the formats' weights and the months' shares in the source."""
    formats, months = sorted({f for s, _ in signatures for f, _ in s}), sorted({m for s, _ in signatures for _, m in s})
    total = sum(n for _, n in signatures)
    weight, share = {f: 1 / len(formats) for f in formats}, {m: 1 / len(months) for m in months}
    for _ in range(rounds):
        of, at = dict.fromkeys(formats, 0.0), dict.fromkeys(months, 1.0)  # one row more a month, so that none is impossible
        for s, n in signatures:
            likely = [weight[f] * share[m] for f, m in s]
            norm = sum(likely)
            for (f, m), x in zip(s, likely):
                part = n * (x / norm if norm else 1 / len(s))
                of[f] += part
                at[m] += part
        fresh, seen = {f: x / total for f, x in of.items()}, {m: x / (total + len(months)) for m, x in at.items()}
        moved = max(max(abs(fresh[f] - weight[f]) for f in formats), max(abs(seen[m] - share[m]) for m in months))
        weight, share = fresh, seen
        if moved < 1e-9:
            break
    return weight, share


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's signatures: the parse with the highest posterior for each that has several."""
    sets = [tuple((f, int(m)) for f, m in (x.split("@") for x in s.split("|"))) for s in pdf["signature"]]
    weight, share = mixture(list(zip(sets, pdf["rows"].tolist())))
    out = []
    for source, signature, s in zip(pdf["source"], pdf["signature"], sets):
        if len(s) > 1:
            likely = [(weight[f] * share[m], f) for f, m in s]
            norm, (top, best) = sum(x for x, _ in likely), max(sorted(likely, key=lambda x: x[1]), key=lambda x: x[0])
            out.append((source, signature, best, top / norm if norm else 1 / len(s)))
    return pd.DataFrame(out, columns=["source", "signature", "chosen", "posterior"])


def _fenced(df: DataFrame) -> DataFrame:
    """df, with what comes after compiled apart from what it is made of.

    All of it in one method would be above the size that the JVM compiles to
    machine code (8,000 bytes), and then runs several times slower.
    """
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def interpret(df: DataFrame, record_id: Column, source: Column, text: Column, zone: Column) -> DataFrame:
    """(record_id, source, host_zone, zone, signature, and the parses) of all readings; signature names the formats that hold, and the months they give."""
    known = F.when(zone.rlike(r"^(UTC|GMT|[A-Z][A-Za-z_]+(/[A-Za-z0-9_+\-]+)+)\z"), zone)
    base = df.select(record_id.cast("bigint").alias("record_id"), F.coalesce(source.cast("string"), F.lit("")).alias("source"), F.trim(text).alias("t"), known.alias("host_zone"))
    month = lambda i: F.floor(F.coalesce(f"utc{i}", f"at{i}") / MONTH).cast("string")
    signature = F.concat_ws("|", *[F.concat(f"format{i}", F.lit("@"), month(i)) for i in (1, 2)])
    walls = _fenced(_pieces(base).select("record_id", "source", "host_zone", "zone", "shape", "offset", "wall1", "wall2", "number", "pair"))
    return _fenced(_parses(walls).select("record_id", "source", "host_zone", "zone", *[f"{c}{i}" for i in (1, 2) for c in ("format", "utc", "at")])).select("record_id", "source", "host_zone", "zone", *[f"{c}{i}" for i in (1, 2) for c in ("format", "utc", "at")], signature.alias("signature"))


def choices(parsed: DataFrame) -> DataFrame:
    """(source, signature, chosen, posterior) of the signatures with several parses: EM per source, on counts."""
    counts = parsed.filter(F.col("signature") != "").groupBy("source", "signature").agg(F.count(F.lit(1)).alias("rows"))
    return counts.groupBy("source").applyInPandas(_choose, "source string, signature string, chosen string, posterior double")


def normalise(df: DataFrame, record_id: Column, source: Column, text: Column, zone: Column, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """(record_id, status, utc_us, format, posterior), one row per reading."""
    parsed = cut(interpret(df, record_id, source, text, zone), "readings")
    table, n = cut_counted(choices(parsed), "formats", n=F.count(F.lit(1)))
    several = F.col("format2").isNotNull()
    sole, open_ = parsed.filter(~several), parsed.filter(several)
    settled = open_.join(F.broadcast(table) if n["n"] <= MAX_TABLE else table, ["source", "signature"], "left")
    rows = sole.withColumns({"chosen": F.col("format1"), "posterior": F.when(F.col("format1").isNotNull(), F.lit(1.0))}).unionByName(settled)
    second = F.col("chosen").eqNullSafe(F.col("format2")) & F.col("format2").isNotNull()
    rows = rows.withColumns({"utc": F.when(second, F.col("utc2")).otherwise(F.col("utc1")), "at": F.when(second, F.col("at2")).otherwise(F.col("at1")), "zone_used": F.coalesce("zone", "host_zone")})
    rows = rows.withColumns({"wall": F.when(F.col("utc").isNull(), F.col("at")), "zone": F.coalesce("zone_used", F.lit("UTC"))})
    rows = resolve_wall(rows, "wall", "zone")
    status = (
        F.when(F.col("at").isNull(), "invalid")
        .when(F.col("posterior") < min_posterior, "undecided")
        .when(F.col("utc").isNotNull(), "ok")
        .when(F.col("zone_used").isNull(), "no_zone")
        .when(F.col("n") == 2, "ambiguous")
        .when(F.col("n") == 0, "nonexistent")
        .otherwise("ok")
    )
    utc = F.when(F.col("status") == "ok", F.coalesce(F.col("utc"), F.col("first"))).otherwise(F.lit(-1).cast("bigint"))
    return rows.withColumn("status", status).select("record_id", "status", utc.alias("utc_us"), F.col("chosen").alias("format"), "posterior")
