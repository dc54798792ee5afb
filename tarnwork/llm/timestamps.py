"""Mixed timestamps to UTC: native parsing, then a broadcast range join with the intervals of each zone's wall time.

A zone's wall time is a line cut into intervals with one answer each: normal ones have one offset, gaps (times that the zone
skips) and overlaps (times that it repeats) have the offsets before and after the change.  The table of intervals holds the
zones of the time zone database alone, about three rows a zone and year, however long the input is; that is what makes it
safe to broadcast.  All parsing is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import stored

#: Blanks stripped from both ends, months, the years that a stamp can name.
BLANKS = " \t\n\x0b\x0c\r"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
YEARS = (2000, 2099)

#: What may follow a date (hour, minute, second, half of the day, offset), and the dates, each with the places of
#: its year, month and day; of slashed ones, month first.
TIME = r"(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AP])M)?(?: ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?\z"
DATES = {
    "iso": (r"^(20[0-9]{2})-([0-9]{2})-([0-9]{2})", "$1|$2|$3"),
    "slashed": (r"^([0-9]{2})/([0-9]{2})/(20[0-9]{2})", "$3|$1|$2"),
    "dotted": (r"^([0-9]{2})[.]([0-9]{2})[.](20[0-9]{2})", "$3|$2|$1"),
    "named": (rf"^([0-9]{{2}}) ({'|'.join(MONTHS)}) (20[0-9]{{2}})", "$3|$2|$1"),
    "packed": (r"^(20[0-9]{2})([0-9]{2})([0-9]{2})", "$1|$2|$3"),
}

#: One order of day and month wins a source with over this many times the votes of the other.
MAJORITY = 3

#: Parts that the rows of one source are dealt to for the join with its votes.
SALTS = 64

MICROS = 1_000_000


@lru_cache(1)
def zones() -> list[str]:
    """Names of the time zone database of the driver."""
    return sorted(available_timezones())


def changes(zone: str, first: datetime, last: datetime, step: timedelta = timedelta(days=7)) -> Iterator[tuple[int, int, int]]:
    """(epoch second, offset before, offset from then on) of each change of a zone's offset, from weekly probes and bisection."""
    tz = ZoneInfo(zone)

    def offset(second: int) -> int:
        return int(datetime.fromtimestamp(second, UTC).astimezone(tz).utcoffset().total_seconds())

    at, end, width = int(first.timestamp()), int(last.timestamp()), int(step.total_seconds())
    was = offset(at)
    while at < end:
        to = min(at + width, end)
        now = offset(to)
        if now != was:
            lo, hi = at, to
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == was else (lo, mid)
            now = offset(hi)
            yield hi, was, now
            to = hi
        at, was = to, now


def intervals_of(zone: str) -> list[tuple[str, int, int, int, str, int, int]]:
    """(zone, year, start, end, kind, offset before, offset after) in wall seconds, cut at the turns of years."""
    first, last = datetime(YEARS[0] - 1, 12, 1, tzinfo=UTC), datetime(YEARS[1] + 1, 2, 1, tzinfo=UTC)
    rows, at = [], int(first.timestamp()) - 86_400
    offset = int(first.astimezone(ZoneInfo(zone)).utcoffset().total_seconds())
    for second, before, after in changes(zone, first, last):
        lo, hi = second + min(before, after), second + max(before, after)
        rows += [(at, lo, "normal", before, before), (lo, hi, "gap" if after > before else "overlap", before, after)]
        at, offset = hi, after
    rows.append((at, int(last.timestamp()) + 86_400, "normal", offset, offset))
    turns = {y: int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in range(YEARS[0], YEARS[1] + 2)}
    cut = []
    for start, end, kind, before, after in rows:
        for y in range(max(YEARS[0], datetime.fromtimestamp(start, UTC).year), min(YEARS[1], datetime.fromtimestamp(end, UTC).year) + 1):
            lo, hi = max(start, turns[y]), min(end, turns[y + 1])
            if lo < hi:
                cut.append((zone, y, lo, hi, kind, before, after))
    return cut


def wall_intervals(named: DataFrame) -> DataFrame:
    """The interval table of the zones in ``named(zone)`` that the database has; a partition works out its own zones."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for z in part["zone"] for r in intervals_of(z)]
            yield pd.DataFrame(rows, columns=["zone", "year", "start", "end", "kind", "before", "after"])

    return named.filter(F.col("zone").isin(zones())).select("zone").distinct().mapInPandas(work, "zone string, year int, start long, end long, kind string, before int, after int")


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of a date; null for a date that the calendar does not have."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    length = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    first = F.make_date(year, F.greatest(F.lit(1), F.least(F.lit(12), month)), F.lit(1))
    return F.when(month.between(1, 12) & day.between(1, length), F.unix_date(first) + day - 1)


def _numbers(part: Column) -> Column:
    """The parts of a stamp (year, month, day, hour, minute, second, half, offset, shape, epoch), numbers as such."""
    year, month, day, hour, minute, second, half, offset, shape, epoch = (part.getItem(i) for i in range(10))
    # what is empty is not cast at all: a cast that fails costs as much as many that do not
    number = lambda x, kind="int": F.when(x != "", x.cast(kind))
    ints = {"y": year, "d": day, "hh": hour, "mm": minute, "oh": offset.substr(2, 2), "om": F.when(offset != "Z", F.right(offset, F.lit(2)))}
    named = F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("int")
    return F.struct(
        *[number(x).alias(c) for c, x in ints.items()],
        F.when(shape == "named", named).otherwise(number(month)).alias("m"),
        F.when(second == "", 0).otherwise(number(second)).alias("ss"),
        half.alias("half"), offset.alias("offset"), shape.alias("shape"), (hour == "").alias("bare"),
        (number(epoch, "long") * F.when(F.length(epoch) == 10, MICROS).otherwise(1000)).alias("epoch_us"),
    )


def _said() -> list[Column]:
    """What the columns of ``_numbers`` say of a stamp."""
    y, m, d, hh, mm, ss, half, offset, oh, om = map(F.col, ("y", "m", "d", "hh", "mm", "ss", "half", "offset", "oh", "om"))
    hour = F.when((half == "") & (hh <= 23), hh).when((half != "") & hh.between(1, 12), hh % 12 + F.when(half == "P", 12).otherwise(0))
    shift = F.when(offset == "Z", 0).when((oh <= 14) & (om <= 59), F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1) * (oh * 3600 + om * 60))
    time = F.when(F.col("bare"), 0).when((mm <= 59) & (ss <= 59) & ((offset == "") | shift.isNotNull()), hour * 3600 + mm * 60 + ss)
    slashed = F.col("shape") == "slashed"
    return [
        y.alias("year"),
        F.col("epoch_us"),
        _days(y, F.when(slashed, d).otherwise(m), F.when(slashed, m).otherwise(d)).alias("days_dm"),
        _days(y, m, d).alias("days_md"),
        slashed.alias("slashed"),
        time.alias("time_s"),
        shift.alias("offset_s"),
    ]


def parse(stamps: DataFrame) -> DataFrame:
    """(stamp_id, source, zone, year, epoch_us, days_dm, days_md, slashed, time_s, offset_s): what a stamp says by itself.

    ``epoch_us`` is set for epochs alone; the days are null for dates that do not exist, and equal unless a slashed date can
    be read in two ways.  ``time_s`` is null for an impossible time or offset, ``offset_s`` null where none is given.  All are
    null for a stamp of no known shape.

    One pattern tells a stamp's shape and lays its parts out in one order.  An inlined array of one keeps the planner from
    copying what stands below it into each place that reads it.
    """
    raw = F.btrim("raw", F.lit(BLANKS))
    epoch = r"^([0-9]{10}|[0-9]{13})\z"
    laid = F.when(raw.rlike(epoch), F.regexp_replace(raw, epoch, "|||||||||$1"))
    for name, (pattern, order) in DATES.items():
        laid = laid.when(raw.rlike(pattern + TIME), F.regexp_replace(raw, pattern + TIME, f"{order}|$4|$5|$6|$7|$8|{name}|"))
    keys = ["stamp_id", "source", "zone"]
    parts = stamps.select(*keys, F.inline(F.array(F.struct(F.split(laid, r"\|", -1).alias("parts")))))
    return parts.select(*keys, F.inline(F.array(_numbers(F.col("parts"))))).select(*keys, *_said())


def normalise(stamps: DataFrame) -> DataFrame:
    """(stamp_id, utc_us, rule, ambiguous) for each row of ``stamps(stamp_id, source, zone, raw)``; other columns are not read.

    A stamp that is null, empty, impossible or of no known shape is ``bad``; so is one that needs its zone where the zone is
    null or not in the time zone database.  Bad stamps do not vote.  Rows without a source are one source together.  Repeated
    rows each vote and each come back.

    Stamps are parsed once, into a written table.  Votes are counted by source, combined before the shuffle, and only slashed dates with two readings meet them, a source's
    rows dealt to ``SALTS`` parts, by a shuffle join.  The interval table is the one broadcast.
    """
    said = parse(stamps)
    dated = F.coalesce("days_dm", "days_md").isNotNull() & F.col("time_s").isNotNull() & (F.col("offset_s").isNotNull() | F.col("zone").isin(zones()))
    said = stored(said.withColumn("good", F.col("epoch_us").isNotNull() | F.coalesce(dated, F.lit(False))))
    dm, md = F.count_if(F.col("days_md").isNull()), F.count_if(F.col("days_dm").isNull())
    votes = said.filter("good AND slashed AND (days_dm IS NULL OR days_md IS NULL)").groupBy("source").agg(dm.alias("dm"), md.alias("md"))
    won = votes.select("source", F.when(F.col("dm") > MAJORITY * F.col("md"), "dm").when(F.col("md") > MAJORITY * F.col("dm"), "md").alias("winner")).filter("winner IS NOT NULL")
    keys = {"_source": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull()}
    won = won.withColumns(keys).select(*keys, "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    twofold = F.coalesce(F.col("good") & F.col("slashed") & (F.col("days_dm") != F.col("days_md")), F.lit(False))
    asked = said.filter(twofold).withColumns(keys).withColumn("_salt", F.pmod(F.xxhash64("stamp_id", "days_md", "time_s"), F.lit(SALTS)).cast("int"))
    asked = asked.join(won.hint("merge"), [*keys, "_salt"], "left")
    asked = asked.select(*said.columns, F.when(F.col("winner") == "dm", F.col("days_dm")).otherwise(F.col("days_md")).alias("days"), F.when(F.col("winner").isNull(), "default").otherwise("votes").alias("rule"))
    rule = F.when(~F.col("good"), "bad").when(F.col("epoch_us").isNotNull(), "epoch").otherwise("plain")
    others = said.filter(~twofold).withColumns({"days": F.coalesce("days_dm", "days_md"), "rule": rule})
    walls = asked.unionByName(others).withColumn("wall", F.col("days").cast("long") * 86_400 + F.col("time_s"))
    walls = walls.withColumn("_zone", F.when(F.col("good") & F.col("epoch_us").isNull() & F.col("offset_s").isNull(), F.col("zone")))
    table = wall_intervals(stamps).select(F.col("zone").alias("_zone"), F.col("year").alias("_year"), "start", "end", "kind", "before")
    within = (walls["_zone"] == table["_zone"]) & (F.col("year") == F.col("_year")) & (F.col("wall") >= F.col("start")) & (F.col("wall") < F.col("end"))
    met = walls.join(F.broadcast(table), within, "left")
    utc = F.when(F.col("good"), F.coalesce("epoch_us", (F.col("wall") - F.coalesce("offset_s", "before")) * MICROS))
    turned = F.coalesce(F.col("kind") != "normal", F.lit(False))
    return met.select("stamp_id", utc.alias("utc_us"), "rule", (F.col("rule").isin("votes", "default") | turned).alias("ambiguous"))
