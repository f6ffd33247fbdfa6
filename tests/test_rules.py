"""Windows, rules and golden traces."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from gatewarden.config import RuleConfig
from gatewarden.functions import cycles
from gatewarden.operators import rules, windows as w

COLS = "seq bigint, ts bigint, session_id string, user_ip string, user_agent string, country string, asn bigint, prompt string, language string, publisher_id string"


def _event(seq, ts, session="s", ip="9.9.9.9", ua="Mozilla/5.0", country="US", asn=None, prompt="p", language="English", publisher="pub"):
    return (seq, ts, session, ip, ua, country, asn, prompt, language, publisher)


def test_counts_of_equal_times(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate((0, 1000, 1000, 61000))], "seq bigint, ts bigint, k string")
    b = w.blocked(df, "k", 60_000)
    b = w.with_windows(b, "k", {"n": (F.lit(1), 60_000)}, {})
    assert [r.n for r in w.unblocked(b).orderBy("seq").collect()] == [1, 2, 3, 3]


def test_windows_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, i * 400 // 1000 * 1000 + r.randrange(2) * 0, r.choice("ab"), r.choice(["x", "y", "z", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "seq bigint, ts bigint, k string, v string")
    b = w.blocked(df, "k", 7000, 9000).withColumn("f", w.first_seen("k", "v", 7000))
    b = w.with_windows(b, "k", {"n": (F.lit(1), 7000), "short": (F.col("ts") % 7, 3000)}, {"d": ("v", 7000), "e": ("v", 2500)})
    got = {x.seq: x for x in w.unblocked(b).collect()}
    assert len(got) == len(rows)
    for s, t, k, v in rows:
        seen = [x for x in rows if x[2] == k and x[1] >= t - 7000 and (x[1], x[0]) <= (t, s)]
        assert got[s].n == len(seen)
        assert got[s].d == len({x[3] for x in seen} - {None})
        assert got[s].short == sum(x[1] % 7 for x in seen if x[1] >= t - 3000)
        assert got[s].e == len({x[3] for x in seen if x[1] >= t - 2500} - {None})
        assert got[s].f == (not any(x[3] == v and x[0] != s for x in seen))


def test_repeat_burst_session(spark):
    df = spark.createDataFrame([_event(i, 1_681_086_600_000 + 1000 * i, prompt="buy this now please") for i in range(18)], COLS)
    got = {r.seq: (r.reasons, r.score, r.verdict) for r in rules.detect(df).collect()}
    assert got[0] == (["publisher_new_ip", "publisher_new_session", "publisher_dispersed_farm"], 0.28, "clean")
    assert got[1] == (["prompt_replay"], 0.45, "suspicious") == got[2]
    for i in range(3, 12):
        assert got[i] == (["regular_cadence", "prompt_replay"], 0.7, "fraud")
    for i in range(12, 18):
        assert got[i] == (["session_burst", "regular_cadence", "prompt_replay"], 1.0, "fraud")


def test_untimed_request_fires_no_window_rule(spark):
    df = spark.createDataFrame([_event(1, None, publisher=None), _event(2, 5, session=None, publisher=None)], COLS)
    assert {(r.score, r.verdict) for r in rules.detect(df).collect()} == {(0.0, "clean")}


def test_geo_language(spark):
    cases = [("Chinese", "US", False), ("Spanish", "CN", True), ("en", "CN", False), ("fr", "JP", True), (None, "CN", False), ("Klingon", "CN", False), (" es ", "mx", False)]
    df = spark.createDataFrame([_event(i, 1, language=l, country=c) for i, (l, c, _) in enumerate(cases)], COLS)
    got = {r.seq: r.g for r in df.select("seq", rules.geo_language_mismatch().alias("g")).collect()}
    assert [got[i] for i in range(len(cases))] == [x[2] for x in cases]


def test_empty_user_agent_is_bad_for_the_rate_only(spark):
    df = spark.createDataFrame([_event(i, 1000 * i, ua="", session=f"s{i}") for i in range(40)], COLS).withColumn("session_flagged", F.lit(False))
    assert df.where(rules.bad_user_agent()).count() == 0
    assert rules.publisher_signals(df).where("publisher_bad_ua_rate").count() == 11


def _cycles(values, least=3):
    """Whether the values are one cycle over and over: its length is the place of the last value that is new."""
    size = max(values.index(v) for v in set(values)) + 1
    whole = len(values) // size
    return len(set(values)) >= least and whole >= 2 and values[: whole * size] == values[:size] * whole


def test_user_agent_cycle(spark):
    assert _cycles(list("abcdeabcde")) and not _cycles(list("abcabd")) and _cycles(list("abcabca"))
    r = random.Random(6)
    agents = ["ABC"[i % 3] if r.random() < 0.97 else "D" for i in range(200)]
    mixed = spark.createDataFrame([_event(i, 20_000 * i, ua=u) for i, u in enumerate(agents)], COLS)
    got = {x.seq for x in rules.with_ua_rotation(mixed).where("publisher_ua_rotation").collect()}
    assert got == {i for i in range(200) if len(w := agents[max(0, i - 30) : i + 1]) >= 10 and _cycles(w)}
    df = spark.createDataFrame([_event(i, 1000 * i, ua="ABCDE"[i % 5]) for i in range(15)], COLS)
    got = {r.seq for r in rules.with_ua_rotation(df).where("publisher_ua_rotation").collect()}
    assert got == {i for i in range(15) if i + 1 >= 10}
    assert rules.publisher_signals(df.withColumn("session_flagged", F.lit(False))).where("publisher_ua_rotation").count() == 0


def test_user_agent_cycles_of_any_window(spark):
    """Several publishers, equal times, missing agents, times far apart; blocks are shorter than the data."""
    r = random.Random(9)
    cfg, rows, base = RuleConfig(rotation_min_requests=4, rotation_min_uas=2), [], 1_700_000_000_000
    for k in range(12):
        cycle, ts = r.choices("ABCD", k=r.randint(2, 5)), base + r.choice([0, 10**12])
        for i in range(150):
            ts += r.choice([0, 5_000, 30_000, 60_000, 400_000])
            ua = cycle[i % len(cycle)] if r.random() < 0.98 else r.choice(["D", " ", None])
            rows.append(_event(len(rows), ts, ua=ua, publisher=None if r.random() < 0.02 else f"p{k}"))
    r.shuffle(rows)
    got = {x.seq for x in rules.ua_rotations(spark.createDataFrame(rows, COLS), cfg).collect()}
    want = set()
    for k in {x[9] for x in rows} - {None}:
        seen = sorted((x[1], x[0], x[4]) for x in rows if x[9] == k and (x[4] or "").strip())
        for t, s, _ in seen:
            mine = [ua for u, q, ua in seen if u >= t - cfg.ms("rotation_s") and (u, q) <= (t, s)]
            if len(mine) >= 4 and _cycles(mine, 2):
                want.add(s)
    assert got == want and 100 < len(want) < 1700


def test_cycles_against_brute_force():
    r = random.Random(4)
    for n in [0, 1, *(r.randrange(2, 60) for _ in range(300))]:
        cycle = r.choices(range(4), k=r.randint(1, 7))
        values = [cycle[i % len(cycle)] if r.random() < 0.97 else r.randrange(4) for i in range(n)]
        since, at = [], 0
        for i in range(n):
            at = min(i, at + r.choice([0, 0, 1, 2]))
            since.append(at)
        got = cycles.cyclic(np.array(values, dtype=int), np.array(since, dtype=int), 2, 4)
        assert got.tolist() == [len(x := values[a : i + 1]) >= 4 and _cycles(x, 2) for i, a in enumerate(since)]


def test_rotation_of_a_busy_publisher(spark):
    """40,000 requests in one window: their cost is not that of 40,000 windows."""
    n = 40_000
    df = spark.range(n).select(F.col("id").alias("seq"), F.col("id").alias("ts"), F.lit("p").alias("publisher_id"), F.concat(F.lit("agent "), (F.col("id") % 500).cast("string")).alias("user_agent"))
    began = time.monotonic()
    assert rules.with_ua_rotation(df).where("publisher_ua_rotation").agg(F.count("*"), F.min("seq")).first()[:] == (n - 999, 999)
    odd = df.withColumn("user_agent", F.when(F.col("seq") == 30_001, "other").otherwise(F.col("user_agent")))
    assert rules.with_ua_rotation(odd).where("publisher_ua_rotation").agg(F.count("*"), F.max("seq")).first()[:] == (30_000 - 999 + 1, 30_000)
    assert time.monotonic() - began < 60


def test_rotation_counts_in_the_score_as_documented(spark):
    df = spark.createDataFrame([_event(i, 1000 * i, ua="ABCDE"[i % 5]) for i in range(15)], COLS)
    got = {r.seq for r in rules.detect(df, RuleConfig(compat=False)).where(F.array_contains("reasons", "publisher_ua_rotation")).collect()}
    assert got == set(range(9, 15))


def test_similar_prompts():
    assert rules.similar("abcdefghij", ["abcdefghix"], 0.9) and not rules.similar("abc", ["xyz", "abcdefgh"], 0.9)


def test_scores_add_in_hundredths(spark):
    df = spark.range(1).select(F.lit(True).alias("regular_cadence"), F.lit(True).alias("prompt_replay"))
    assert rules.scored(df, ("regular_cadence", "prompt_replay"), RuleConfig()).first().verdict == "fraud"


def test_empty_input(spark):
    assert rules.detect(spark.createDataFrame([], COLS)).count() == 0


def test_address_burst(spark):
    df = spark.createDataFrame([_event(i, 1000 * i, session=f"s{i}") for i in range(10)] + [_event(99, 1, ip=" ")], COLS)
    assert {r.seq for r in rules.ip_burst(df).where("ip_burst").collect()} == {8, 9}
