"""Line dedup, fill-in-middle and timestamps against plain versions, with nulls, empties, ties, repeats and clashing names."""

import random
import re
from collections import defaultdict
from datetime import UTC, datetime, timedelta
from hashlib import sha256
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwork.llm import infill, lines, timestamps

BLANKS = " \t\n\x0b\x0c\r"


def lower(x: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def plain_lines(docs: list[tuple[int, str]], min_chars=20, min_docs=3) -> list[tuple]:
    where = defaultdict(set)
    for i, text in docs:
        for line in text.split("\n"):
            key = lower(line.strip(BLANKS))
            if len(key) >= min_chars:
                where[key].add(i)
    out = []
    for i, text in docs:
        all_ = text.split("\n")
        kept = [x for x in all_ if len(where[k := lower(x.strip(BLANKS))]) < min_docs or i == max(where[k])]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_against_a_plain_version(spark):
    rng = random.Random(3)
    stock = [f"a shared line of number {k} with ünïcode" for k in range(6)] + ["Short", "", "x" * 19, "\t Every document HOLDS this line \x0b", "every document holds this line"]
    docs = [(i, "\n".join(rng.choice(stock) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    docs += [(500, "\n".join(["every document holds this line"] * 4000)), (7, docs[7][1]), (8, "another text of a repeated id\n" + stock[0])]
    df = spark.createDataFrame([(i, t, "c", "k") for i, t in docs], "doc_id long, text string, keep string, tag string").repartition(7)
    got = sorted(tuple(r) for r in lines.drop_repeated_lines(df).select("doc_id", "n_lines", "n_dropped", "kept").collect())
    assert got == plain_lines(docs)


def test_lines_of_null_ids_null_texts_and_no_rows(spark):
    line = "a line that three documents share"
    rows = [(None, line), (None, line), (1, line + "\nown"), (2, None), (3, "")]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((r["doc_id"] is None, r["kept"]) for r in got)
    # rows without an id come after all others, so one of them keeps the line
    assert kept == [(False, ""), (False, ""), (False, "own"), (True, ""), (True, line)]
    assert lines.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 1), st.integers(0, 5), st.integers(0, 3)), max_size=60), st.integers(1, 4), st.integers(1, 9), st.integers(2, 4))
def test_edges_of_partitions_and_batches(rows, partitions, size, min_docs):
    rows = sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3]))
    goes, open_, seen = [], [], defaultdict(set)
    cuts = np.linspace(0, len(rows), partitions + 1).astype(int)
    for a, b in zip(cuts, cuts[1:]):
        part = rows[a:b]
        batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*part[i : i + size])], ["high", "low", "doc_id", "place"]) for i in range(0, len(part), size)]
        for made in lines._settle(min_docs)(iter(batches)):
            for r in made.to_pylist():
                key = (r["high"], r["low"])
                if r["kind"] == lines.SEEN:
                    seen[key].add(r["doc_id"])
                else:
                    (goes if r["kind"] == lines.GOES else open_).append((*key, r["doc_id"], r["place"]))
    goes += [r for r in open_ if len(seen[r[:2]]) >= min_docs and r[2] < max(seen[r[:2]])]
    docs = defaultdict(set)
    for r in rows:
        docs[r[:2]].add(r[2])
    assert sorted(goes) == sorted(r for r in rows if len(docs[r[:2]]) >= min_docs and r[2] < max(docs[r[:2]]))


def plain_infill(i, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_against_a_plain_version(spark):
    rng = random.Random(5)
    alphabet = ["word", "A", "é", "語", "🜁", " ", "\n", "<", "P", ">", "M", "1"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 40, 3000])))) for i in range(150)]
    rows += [(900, "z" * 200_000), (901, "é" * 100_000), (902, None), (903, "has <P> a mark"), (904, "<" * 50), (5, rows[5][1]), (5, "other"), (None, "no id at all")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int")
    made = infill.fill_in_middle(df).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    assert got == sorted(((i, *plain_infill(i, t), t or "") for i, t in rows), key=repr)
    assert infill.fill_in_middle(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZ é語🜁-\n<"), max_size=80), st.integers(1, 5), st.integers(1, 7), st.integers(1, 5))
def test_checkpoints_find_every_unit(text, every, block, step):
    raw = text.encode()
    index = infill.Checkpoints(raw, every, block)
    starts = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
    assert index.n == len(starts) - 1
    assert len(index.units) == -(-index.n // every)
    for unit, at in enumerate(starts):
        assert index.at(unit, step) == (len(text[:at].encode()), at)


def us(*wall, offset=0.0):
    return int((datetime(*wall, tzinfo=UTC) - timedelta(hours=offset)).timestamp()) * 1_000_000


NY, BERLIN = "America/New_York", "Europe/Berlin"
STAMPS = [
    ("a", "UTC", " 1700000000\t", (1_700_000_000_000_000, "epoch", False)),
    ("a", None, "1700000000123", (1_700_000_000_123_000, "epoch", False)),
    ("a", "UTC", "17000000001", (None, "bad", False)),
    ("a", BERLIN, "2024-02-29", (us(2024, 2, 29, offset=1), "plain", False)),
    ("a", BERLIN, "2023-02-29", (None, "bad", False)),
    ("a", BERLIN, "20240701T10:20:30", (us(2024, 7, 1, 10, 20, 30, offset=2), "plain", False)),
    ("a", BERLIN, "2024-03-31 02:30", (us(2024, 3, 31, 2, 30, offset=1), "plain", True)),
    ("a", BERLIN, "2024-03-31 03:00", (us(2024, 3, 31, 3, 0, offset=2), "plain", False)),
    ("a", BERLIN, "27.10.2024 02:59:59", (us(2024, 10, 27, 2, 59, 59, offset=2), "plain", True)),
    ("a", BERLIN, "27.10.2024 03:00", (us(2024, 10, 27, 3, 0, offset=1), "plain", False)),
    ("a", NY, "03 Nov 2024 01:30 AM", (us(2024, 11, 3, 1, 30, offset=-4), "plain", True)),
    ("a", NY, "03 Nov 2024 12:30 AM", (us(2024, 11, 3, 0, 30, offset=-4), "plain", False)),
    ("a", NY, "03 Nov 2024 12:30PM Z", (us(2024, 11, 3, 12, 30), "plain", False)),
    ("a", NY, "03 nov 2024", (None, "bad", False)),
    ("a", NY, "2024-01-01 13:00 PM", (None, "bad", False)),
    ("a", NY, "2024-01-01 00:00 AM", (None, "bad", False)),
    ("a", NY, "2024-01-01 24:00", (None, "bad", False)),
    ("a", NY, "2024-01-01 10:60", (None, "bad", False)),
    ("a", NY, "2024-01-01 10:00:60", (None, "bad", False)),
    ("a", None, "2024-01-01T10:00+0530", (us(2024, 1, 1, 10, offset=5.5), "plain", False)),
    ("a", None, "2024-01-01T10:00 -14:59", (us(2024, 1, 2, 0, 59), "plain", False)),
    ("a", None, "2024-01-01T10:00-15:00", (None, "bad", False)),
    ("a", None, "2024-01-01T10:00", (None, "bad", False)),
    ("a", "Nowhere/Land", "2024-01-01T10:00", (None, "bad", False)),
    ("a", "UTC", "2024-01-01T10:00\nZ", (None, "bad", False)),
    ("a", "UTC", "1999-01-01", (None, "bad", False)),
    ("a", "UTC", None, (None, "bad", False)),
    ("a", "UTC", "", (None, "bad", False)),
    # no votes: month first; equal parts are one date
    ("none", "UTC", "02/01/2024", (us(2024, 2, 1), "default", True)),
    ("none", "UTC", "05/05/2024 07:00", (us(2024, 5, 5, 7), "plain", False)),
    # four votes against one: over three times as many; an impossible time does not vote
    *[("eu", "UTC", f"{d}/01/2024", (us(2024, 1, d), "plain", False)) for d in (13, 14, 15, 16)],
    ("eu", "UTC", "01/13/2024", (us(2024, 1, 13), "plain", False)),
    ("eu", "UTC", "01/14/2024 24:00", (None, "bad", False)),
    ("eu", "UTC", "02/01/2024", (us(2024, 1, 2), "votes", True)),
    # three against one: not enough
    *[("tie", "UTC", f"{d}/01/2024", (us(2024, 1, d), "plain", False)) for d in (13, 14, 15)],
    ("tie", "UTC", "01/13/2024", (us(2024, 1, 13), "plain", False)),
    ("tie", "UTC", "02/01/2024", (us(2024, 2, 1), "default", True)),
    # rows without a source are one source
    (None, "UTC", "25/01/2024", (us(2024, 1, 25), "plain", False)),
    (None, "UTC", "02/01/2024", (us(2024, 1, 2), "votes", True)),
    ("", "UTC", "02/01/2024", (us(2024, 2, 1), "default", True)),
]


def test_stamps(spark):
    rows = [(i, s, z, raw, "x", 1) for i, (s, z, raw, _) in enumerate(STAMPS)]
    df = spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string, rule string, year int")
    got = {r["stamp_id"]: (r["utc_us"], r["rule"], r["ambiguous"]) for r in timestamps.normalise(df).collect()}
    assert {i: (STAMPS[i][:3], got[i]) for i in got} == {i: (x[:3], x[3]) for i, x in enumerate(STAMPS)}
    assert timestamps.normalise(df.limit(0)).count() == 0
    twice = timestamps.normalise(df.union(df))
    assert twice.count() == 2 * len(rows)


@pytest.mark.parametrize("zone", ["America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "Pacific/Apia", "Asia/Kolkata"])
def test_intervals_are_the_zone(zone):
    """The intervals of a zone follow each other without holes and give the offsets that the time zone database gives."""
    rows = sorted(timestamps.intervals_of(zone), key=lambda r: r[2])
    assert all(a[3] == b[2] for a, b in zip(rows, rows[1:]))
    tz, rng = ZoneInfo(zone), random.Random(zone)
    for _, year, start, end, kind, before, after in rows:
        for second in (start, end - 1, rng.randrange(start, end)):
            wall = datetime.fromtimestamp(second, UTC).replace(tzinfo=None)
            assert wall.year == year
            early, late = (int(wall.replace(tzinfo=tz, fold=f).utcoffset().total_seconds()) for f in (0, 1))
            assert (early, late) == (before, after)
            assert kind == ("normal" if early == late else "gap" if late > early else "overlap")
