"""Exactly-once delivery and late rows."""

import datetime as dt
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gatewarden.functions.text import clean_id
from gatewarden.functions.times import iso_hour, iso_timestamp
from gatewarden.operators.dedup_index import DedupIndex, build_index, exactly_once, superfluous
from gatewarden.operators.late_replay import HourlyReplay, ReplayState, hourly_counts

ROWS = "delivery_id bigint, req_id string, prefix string"


def test_superfluous_rows_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, "", " ", " A1\n", "a1", "B2 ", "hot", "HOT", f"id{r.randrange(60)}"]), "x") for i in range(1, 400)]
    rows += [(i, "hot", None) for i in range(400, 600)]  # a third of all rows
    df = spark.createDataFrame(rows, ROWS)
    first = {}
    for i, k, _ in rows:
        k = (k or "").strip().lower()
        if k:
            first.setdefault(k, i)
    want = {i for i, k, _ in rows if (k or "").strip() and first[(k or "").strip().lower()] != i}
    index = build_index(df, "req_id", "delivery_id", rounds=5, prefixes=7)
    assert index.merges > 0
    assert {x[0] for x in superfluous(df, index, "req_id", "delivery_id").collect()} == want
    kept = exactly_once(df, index, "req_id", "delivery_id")
    assert kept.columns == df.columns and {x[0] for x in kept.collect()} == {i for i, _, _ in rows} - want


def test_dedup_of_an_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert superfluous(df, build_index(df, "req_id", "delivery_id"), "req_id", "delivery_id").count() == 0


def test_later_batches_find_earlier_identifiers(spark):

    index = DedupIndex(spark, prefixes=3, merge_every=1)
    for batch in ([(1, "a", ""), (2, "b", "")], [(3, "a", ""), (4, "c", "")], [(5, "c", ""), (6, "c", "")]):
        index.ingest(spark.createDataFrame(batch, ROWS), F.col("req_id"), F.col("delivery_id"))
    assert sorted(x[0] for x in index.kept().collect()) == [1, 2, 4]


def test_event_times(spark):
    cases = {
        "2024-03-01T00:15:50+00:00": "2024-03-01 00:15:50", "2024-03-01T02:04:54.570+02:00": "2024-03-01 00:04:54.570", "2024-02-29T19:01:46-0500": "2024-03-01 00:01:46",
        "2024-03-01 00:00:10": "2024-03-01 00:00:10", " 2024-03-01T00:22:42z ": "2024-03-01 00:22:42", "2024-03-01": "2024-03-01 00:00:00", "yesterday": None, "": None, "2024-13-01T00:00:00Z": None, "2024": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r[0]: r[1] for r in df.select("t", iso_timestamp(F.col("t")).cast("string")).collect()}
    for k, v in cases.items():
        assert (got[k] or "").rstrip("0").rstrip(".") == (v or "").rstrip("0").rstrip("."), k
    assert got[None] is None
    assert spark.range(1).select(iso_hour(F.lit(474581))).first()[0] == "2024-02-21T05:00:00Z"


def test_late_rows_against_counting(spark):
    r = random.Random(3)
    base = dt.datetime(2024, 3, 1)
    rows = []
    for i in range(1500):
        e = base + dt.timedelta(minutes=r.randrange(60 * 50))
        late = r.choice([0, 1, 30, 120, 500, 1000])
        rows.append((r.choice(["hot", "hot", "b", " C ", None]), e, e + dt.timedelta(minutes=late, microseconds=r.randrange(2)), "x"))
    df = spark.createDataFrame(rows, "key string, e timestamp, a timestamp, hour string")
    got = {(x.key, x.hour): x for x in hourly_counts(df, clean_id(F.col("key")), F.col("e"), F.col("a")).collect()}
    want = defaultdict(Counter)
    for k, e, a, _ in rows:
        if k:
            hour = int((e - dt.datetime(1970, 1, 1)).total_seconds() // 3600)
            end = dt.datetime(1970, 1, 1) + dt.timedelta(hours=hour + 1)
            want[k.strip().lower(), hour][0 if a <= end + dt.timedelta(minutes=5) else 1 if a <= end + dt.timedelta(hours=6) else 2] += 1
    assert set(got) == set(want)
    for k, c in want.items():
        x = got[k]
        assert (x.first_count, x.final_count, x.n_late, x.n_dropped) == (c[0], c[0] + c[1], c[1], c[2])
        if x.final_count:
            day = k[1] // 24
            assert x.day_count == sum(v[0] + v[1] for (kk, h), v in want.items() if kk == k[0] and h // 24 == day and h <= k[1])


def _state(*deltas):
    s = ReplayState(5, 360)
    for minute, arrival in deltas:
        s.add(minute, arrival, 1)
    return s


def _table(s):
    flat = s.rows()
    return {flat[i]: tuple(flat[i + 1 : i + 7]) for i in range(0, len(flat), 7)}


DELTAS = ((0, 1), (61, 62), (130, 131), (5, 190), (62, 191), (200, 210), (6, 500))


def test_replay_restores_checkpoints_and_replaces_outputs():
    got = _table(_state(*DELTAS))
    #             first, final, day, late, dropped, replays
    assert got == {0: (1, 2, 2, 1, 1, 1), 1: (1, 2, 4, 1, 0, 1), 2: (1, 1, 5, 0, 0, 0), 3: (1, 1, 6, 0, 0, 0)}


def test_nothing_is_counted_without_replay(monkeypatch):
    monkeypatch.setattr(ReplayState, "_replay", lambda self, hour: None)
    assert all(final == late == day == 0 for _, final, day, late, _, _ in _table(_state(*DELTAS)).values())


def test_a_saved_state_goes_on():
    for cut in range(len(DELTAS) + 1):
        a = _state(*DELTAS[:cut])
        b = ReplayState(5, 360)
        b.restore(a.water, *a.save())
        for minute, arrival in DELTAS[cut:]:
            b.add(minute, arrival, 1)
        assert {h: v[:5] for h, v in _table(b).items()} == {h: v[:5] for h, v in _table(_state(*DELTAS)).items()}, cut


def test_batches_agree_with_one(spark):
    r = random.Random(4)
    base = dt.datetime(2024, 3, 1)
    rows = [(r.choice("ab"), e, e + dt.timedelta(minutes=r.choice([0, 3, 100, 400, 900]))) for e in (base + dt.timedelta(minutes=r.randrange(3000)) for _ in range(600))]
    df = spark.createDataFrame(rows, "key string, e timestamp, a timestamp")
    columns = ("key", "hour", "first_count", "final_count", "day_count", "n_late", "n_dropped")
    once = sorted(tuple(x) for x in hourly_counts(df, F.col("key"), F.col("e"), F.col("a")).select(*columns).collect())
    job = HourlyReplay()
    for lo, hi in ((0, 900), (900, 2000), (2000, 9999)):
        limits = [F.lit(base + dt.timedelta(minutes=m)) for m in (lo, hi)]
        out = job.ingest(df.where((F.col("a") >= limits[0]) & (F.col("a") < limits[1])), F.col("key"), F.col("e"), F.col("a"))
    assert sorted(tuple(x) for x in out.select(*columns).collect()) == once


def test_late_rows_of_an_empty_table(spark):
    df = spark.createDataFrame([], "key string, e timestamp, a timestamp")
    assert hourly_counts(df, F.col("key"), F.col("e"), F.col("a")).count() == 0


def test_index_is_reopened(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = spark.createDataFrame([(i, f"id{i % 7}") for i in range(10)], "o bigint, k string")
    index = DedupIndex(spark, prefixes=4, folder=folder)
    index.ingest(rows.where("o < 5"), F.col("k"), F.col("o"))
    again = DedupIndex.open(spark, folder)
    again.ingest(rows.where("o >= 5"), F.col("k"), F.col("o"))
    last = DedupIndex.open(spark, folder)
    assert last.version == 2 and sorted(r[0] for r in last.kept().collect()) == list(range(7))
    assert sorted(r[0] for r in superfluous(rows, last, "k", "o").collect()) == [7, 8, 9]
