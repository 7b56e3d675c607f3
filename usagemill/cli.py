"""python -m usagemill.cli REPORT --source AGENT=PATH ... --prices FILE [options]

Reports: daily, weekly, monthly, session, blocks, unified. Rows are printed as
JSON, one a line, or written with --to.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.functions.names import parse_aliases
from usagemill.plans import reports
from usagemill.plans.reports import ReportOptions
from usagemill.session import cut
from usagemill.sources.agents import READERS, read_all

PRICE = "model string, input_rate double, output_rate double, cache_create_rate double, cache_read_rate double, fast_factor double, input_above_rate double, output_above_rate double, cache_create_above_rate double, cache_read_above_rate double, context_threshold bigint"
UNITS = {"daily": "day", "weekly": "week", "monthly": "month"}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="usagemill")
    p.add_argument("report", choices=[*UNITS, "session", "blocks", "unified"])
    p.add_argument("--source", action="append", required=True, metavar="AGENT=PATH", help=f"one of {', '.join(READERS)}")
    p.add_argument("--prices", help="JSON lines with a model and its rates per token")
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--last", type=int)
    p.add_argument("--today")
    p.add_argument("--project")
    p.add_argument("--mode", choices=["auto", "calculate", "display"], default="auto")
    p.add_argument("--order", choices=["asc", "desc"], default="asc")
    p.add_argument("--timezone", default="UTC")
    p.add_argument("--week-start", default="sunday")
    p.add_argument("--session-length", type=float, default=5.0)
    p.add_argument("--active", action="store_true")
    p.add_argument("--recent", action="store_true")
    p.add_argument("--token-limit")
    p.add_argument("--aliases", default="")
    p.add_argument("--instances", action="store_true", help="by project too")
    p.add_argument("--no-cost", action="store_true")
    p.add_argument("--id", help="one session's rows")
    p.add_argument("--unit", choices=["day", "week", "month"], default="day")
    p.add_argument("--sql", help="a query over the view report")
    p.add_argument("--now", type=int, default=None, help="epoch milliseconds")
    p.add_argument("--to", help="write JSON files to this folder")
    return p.parse_args(argv)


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    limit = a.token_limit if a.token_limit in (None, "max") else int(a.token_limit)
    o = ReportOptions(
        a.since, a.until, a.last, a.today, a.project, a.mode, a.order, a.timezone, a.week_start, a.session_length, int(time.time() * 1000) if a.now is None else a.now,
        a.active, a.recent, limit, parse_aliases(a.aliases), a.instances, not a.no_cost,
    )
    all_time = a.since is None and a.until is None and a.last is None
    usage = read_all(spark, dict(s.split("=", 1) for s in a.source), aggregates=a.report == "session" and all_time)
    usage = cut(usage, "usage")  # read and made unique once, not once more for the names' prices
    price = spark.read.schema(PRICE).json(a.prices) if a.prices else spark.createDataFrame([], PRICE)
    if a.report in UNITS:
        out = reports.periods(usage, price, UNITS[a.report], o)
    elif a.report == "session":
        out = reports.session(usage, price, a.id, o) if a.id else reports.sessions(usage, price, o)
    elif a.report == "blocks":
        out = reports.billing_blocks(usage, price, o)
    else:
        out = reports.unified(usage, price, a.unit, o)
    return reports.select_sql(out, a.sql) if a.sql else out


def main() -> None:
    a = arguments()
    spark = SparkSession.builder.appName("usagemill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = run(spark, a)
    if a.to:
        out.write.mode("overwrite").json(a.to)
    else:
        for row in reports.as_json(out).select(F.col("json")).toLocalIterator():
            print(row.json)


if __name__ == "__main__":
    main()
