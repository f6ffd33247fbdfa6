"""Events, history, metrics, moderation, features, sources, streams, generators."""

import json

import pytest
from pyspark.sql import functions as F

from gatewarden import config
from gatewarden.datagen import attacks
from gatewarden.functions.text import first_non_empty, normalise, term_hit
from gatewarden.config import RuleConfig
from gatewarden.operators import evaluate, events, features, history, moderation, rules
from gatewarden.sources import readers, writers
from gatewarden.streaming import detector


def test_tolerant_parsing(spark):
    lines = ["{bad", "[1]", "null", json.dumps({"req_id": 5, "optional_context": {"asn": "7"}}), json.dumps({"optional_context": {"asn": "x"}, "request_context": 3}), json.dumps({"optional_context": {"asn": 7.9}}), json.dumps({"prompt": None}), None]
    df = events.parse_json(spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string"), "value")
    got = {r.i: r for r in df.select("i", "parse_error", events.raw_request().alias("q")).collect()}
    assert [got[i].parse_error for i in range(8)] == ["invalid_json", "invalid_event_type", "invalid_event_type", None, None, None, None, "invalid_json"]
    assert got[3].q.req_id == "5" and got[3].q.optional_context.asn == 7
    assert got[4].q.optional_context.asn is None and got[4].q.request_context.session_id == ""
    assert got[5].q.optional_context.asn == 7 and got[6].q.prompt == ""


def test_reasons_are_always_a_list(spark):
    df = events.parse_json(spark.createDataFrame([('{"r": ["a", "b"]}',), ('{"r": "a"}',), ("{}",)], "value string"), "value")
    assert [r[0] for r in df.select(events.reasons_at("$.r")).collect()] == [["a", "b"], ["a"], []]


def test_blocked_envelope_refuses_unknown_verdicts(spark):
    q = F.struct(F.lit("t").alias("event_time"), F.lit("r").alias("req_id"), F.lit("p").alias("publisher_id"))
    make = lambda v: spark.range(1).select(events.blocked(q, F.lit("flink"), F.lit(v), F.lit(1.0), F.array(F.lit("x"))).alias("b"))
    assert make("fraud").first().b.req_id == "r"
    with pytest.raises(Exception, match="no such source"):
        make("clean").collect()


def test_term_gap(spark):
    df = spark.createDataFrame([("a b b x c",), ("a x b c",), ("a b x c",), ("z a b c",), ("a bc",), (None,)], "t string")
    assert [r[0] for r in df.select(term_hit(F.col("t"), "a b c")).collect()] == [False, True, True, True, False, False]


def test_normaliser(spark):
    df = spark.createDataFrame([("Fr33  M0ney!! n0w_ok",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(normalise(F.col("t"))).collect()] == ["free money now ok", "", None]
    n = moderation.compatibility_form(spark.createDataFrame([("ＦＲＥＥ money",), (None,)], "t string"), "t", "n").select("n", moderation.hits(F.col("n")).alias("h")).collect()
    assert n[0].n == "free money" and n[0].h == ["free money"] and n[1].n == ""


def test_history(spark):
    ev = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c")], "o bigint, k string")
    labels = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("c", 1, 1)], "k string, y int, o bigint")
    assert sorted((r.k, r.y) for r in history.label_join(ev.drop("o"), labels, "k", "o").collect()) == [("a", 1), ("a", 1), ("c", 1)]
    got = {r.status: r.n for r in history.export_status(ev, labels, ev.where("k = 'c'"), "k", "o").collect()}
    assert got == {"exported": 1, "duplicate_topic": 1, "skipped_unlabeled": 1, "no_req_id": 1, "already_exported": 1, "consumed": 5}
    assert {(r.k, r.o) for r in history.first_per_key(ev, "k", "o").collect()} == {("a", 1), ("b", 3), (None, 4), ("c", 5)}


def test_stratified_split_shares(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = {(r.y, r.is_train): r["count"] for r in history.stratified_split(df, "k", "y").groupBy("y", "is_train").count().collect()}
    assert got == {(0, True): 720, (0, False): 180, (1, True): 80, (1, False): 20}


def test_metrics_without_cases(spark):
    df = spark.createDataFrame([], "p boolean, a boolean")
    r = evaluate.confusion(df, F.col("p"), F.col("a")).collect()
    assert [(x.tp, x.tpr, x.prec) for x in r] in ([], [(0, 0.0, 0.0)])


def test_sweep_leaves_suspicious_out_of_missed(spark):
    hist = spark.createDataFrame([(1, 5, 3), (2, 2, 4), (0, 9, 1)], "mask bigint, clean bigint, fraud bigint")
    r = evaluate.sweep(hist, [([80, 40], 30, 70)]).first()
    assert (r.tp, r.fp, r.fn, r.sus_fraud, r.sus_clean) == (3, 5, 1, 4, 2)
    assert len(evaluate.weight_grid([1] * 14, {11: [1] * 4, 4: [1] * 4, 3: [1] * 3, 7: [1] * 3, 2: [1] * 4, 6: [1] * 3}, [35, 40, 45], [50, 55, 60, 65, 70])) == 25_920


def test_features_and_model(spark, tmp_path):
    rows = [(0.65, 12345, "Click here for a free bitcoin offer!!", ["bad_user_agent", "session_burst"]), (0.1, 64512, "x" * 33, []), (None, None, None, None)]
    df = spark.createDataFrame(rows, "s double, a bigint, p string, r array<string>")
    got = [tuple(x) for x in df.select(*[c.alias(n) for n, c in features.features(F.col("s"), F.col("a"), F.col("p"), F.col("r")).items()]).collect()]
    assert got == [(0.65, 12345.0, 37.0, 1, 2.0, 1, 1), (0.1, 64512.0, 33.0, 0, 0.0, 0, 0), (0.0, 0.0, 0.0, 0, 0.0, 0, 0)]
    many = spark.range(60).select(*[((F.col("id") % 2) * 1.0 + i).alias(c) for i, c in enumerate(features.COLUMNS)], (F.col("id") % 2).cast("int").alias("is_fraud"))
    model = features.train(many, trees=3)
    features.save(model, spark, str(tmp_path / "m"), "v1")
    loaded, meta = features.load(spark, str(tmp_path / "m"))
    assert features.resolve_threshold(None, meta) == 0.5 and features.resolve_threshold(0.3, meta) == 0.3
    assert features.score(loaded, many).where("(model_verdict = 'fraud') <> (is_fraud = 1)").count() == 0
    with pytest.raises(ValueError, match="one class"):
        features.train(many.where("is_fraud = 1"))
    with pytest.raises(ValueError, match="too few"):
        features.train(many.limit(3))


def test_provider_judges_each_text_once_and_allows_on_error(spark):
    df = spark.createDataFrame([(1, "bad"), (2, "bad"), (3, "ok"), (4, None), (5, "boom")], "i int, t string")

    def judge(t):
        if t == "boom":
            raise RuntimeError("no answer")
        return t == "bad", 1.2 if t == "bad" else 0.12345, ["hate/threat"]

    got = {r.i: (r.flagged, r.provider_score, r.provider_error, r.provider_message) for r in moderation.with_provider(df, "i", "t", judge).collect()}
    assert got == {1: (True, 1.0, False, ""), 2: (True, 1.0, False, ""), 3: (False, 0.123, False, ""), 4: (False, None, None, None), 5: (False, 0.0, True, "no answer")}
    out = {r.i: (r.verdict, r.method, r.reasons, r.openai_called, r.openai_reason) for r in moderation.moderate(df, "i", "t", judge=judge, audit_share=1.0).collect()}
    assert out[1] == ("unsafe", "openai", ["HATE_THREAT"], True, "") and out[3] == ("clean", "openai", ["HATE_THREAT"], True, "")
    assert out[5] == ("clean", "openai_error_allow", ["openai_error_allowed"], True, "no answer")
    rest = {r.i: (r.verdict, r.method, r.openai_called) for r in moderation.moderate(df, "i", "t", judge=judge, audit_share=0.0).collect()}
    assert set(rest.values()) == {("clean", "tfidf_gate", False)} and len(rest) == 5


def test_moderation_messages(spark):
    df = spark.createDataFrame([(1, "free money today"), (2, "hello"), (3, None)], "i int, prompt string")
    own = F.struct(F.lit("t").alias("event_time"), F.col("i").cast("string").alias("req_id"), F.lit("p").alias("publisher_id"), "prompt")
    out = moderation.moderation_messages(moderation.moderate(df, "i", "prompt"), own, version="v")
    got = {json.loads(r.value)["req_id"]: (r.topic, json.loads(r.value)) for r in out.collect()}
    assert got["1"][0] == config.TOPICS["fraud"] and (got["1"][1]["source"], got["1"][1]["verdict"], got["1"][1]["reasons"]) == ("moderation", "unsafe", ["similarity_above_threshold"])
    assert got["2"][0] == got["3"][0] == config.PASSED_TOPIC and got["2"][1]["moderation"]["method"] == "tfidf_gate"


def test_scored_events_are_blocked_or_cleared(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "id string, fraud_probability double").withColumn("model_verdict", F.when(F.col("fraud_probability") >= 0.5, "fraud").otherwise("clean"))
    q = F.struct(F.lit("t").alias("event_time"), F.col("id").alias("req_id"), F.lit("p").alias("publisher_id"))
    got = {json.loads(r.value)["req_id"]: (r.topic, json.loads(r.value)) for r in features.score_messages(df, q, "v1").collect()}
    assert got["a"][0] == "requests.fraud" and got["a"][1]["source"] == "rfc_scoring" and got["a"][1]["request"]["rfc"]["model_version"] == "v1"
    assert got["b"][0] == "requests.clean" and got["b"][1]["rfc"]["verdict"] == "clean"


def test_similarity_against_brute_force(spark):
    import math
    from collections import Counter

    refs, terms = ["steal saved passwords", "free coins"], ("win prize",)
    texts = ["steal saved passwords", "zzz qqq", "", None, "free lunch", "win a prize", "free free coins coins"]
    grams = lambda t: Counter(f" {w} "[i : i + n] for w in (t or "").split() for n in (3, 4, 5) for i in range(len(w) + 3 - n))
    corpus = [grams(t) for t in (*refs, *terms)]
    df_ = Counter(g for c in corpus for g in c)
    vec = lambda c: {g: (1 + math.log(n)) * (math.log((1 + len(corpus)) / (1 + df_[g])) + 1) for g, n in c.items() if g in df_}
    cos = lambda a, b: sum(x * b.get(g, 0) for g, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a and b else 0.0
    ref = spark.createDataFrame(list(enumerate(refs, 1)), "ref_id bigint, n string")
    got = {r.k: r for r in moderation.max_similarity(spark.createDataFrame(list(enumerate(texts)), "k bigint, n string"), "k", "n", ref, "ref_id", "n", terms).collect()}
    for k, t in enumerate(texts):
        each = [cos(vec(grams(t)), vec(c)) for c in corpus]
        assert got[k].similarity == pytest.approx(max(each), abs=1e-8)
        assert got[k].ref_id == (each.index(max(each)) + 1 if max(each) > 0 and each.index(max(each)) < 2 else None)


def test_readers_and_writers(spark, tmp_path):
    p = tmp_path / "a" / "b"
    p.mkdir(parents=True)
    (p / "x.jsonl").write_text('{"k": 1}\n\n{"k": "two"}\nnot json\n')
    assert readers.json_lines(spark, str(p / "x.jsonl")).count() == 2
    with pytest.raises(Exception, match="invalid_json"):
        readers.json_lines(spark, str(p / "x.jsonl"), strict=True).collect()
    spark.createDataFrame([(5,)], "k int").coalesce(1).write.parquet(str(p / "t"))
    (next((p / "t").glob("*.parquet"))).rename(p / "y.parquet")
    assert sorted(r.k for r in readers.folder_rows(spark, str(tmp_path), "k int").collect() if r.k) == [1, 5]
    df = spark.createDataFrame([("train", "b", 1), ("train", "a", 2), ("test", "c", 3)], "split string, t string, v int")
    writers.write_splits(df, str(tmp_path / "out"), "split", "t")
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    env = tmp_path / ".env"
    env.write_text("# c\nGW_TEST_A='x y'\nnothing\n")
    assert readers.load_env(str(env)) == {"GW_TEST_A": "x y"} and readers.load_env(str(tmp_path / "none")) == {}


def test_log_lines_round_trip(spark):
    df = spark.range(1).select(events.log_line(F.lit("fraud"), F.lit("r1"), F.lit(0.7), F.array(F.lit("a"), F.lit("b")), F.lit("t")).alias("value"))
    assert df.first().value == '[flink-fraud] FRAUD req_id=r1 score=0.700 reasons=["a", "b"] -> t'
    assert tuple(readers.read_log(df).first()) == ("fraud", "r1", 0.7, ["a", "b"], "t")


def _traffic(n=260):
    import random

    r = random.Random(9)
    out = []
    for i in range(n):
        s = r.randrange(9)
        out.append((
            i, 1_700_000_000_000 + 2000 * i, f"s{s}" if s else None, r.choice(["9.9.9.9", "8.8.8.8", " ", f"7.7.7.{s}"]), r.choice(["Mozilla/5.0", "Mozilla/5.0", "curl/8", "", "Opera"]),
            r.choice(["US", "us", "DE", "FR", None, "JP", "CN"]), r.choice([None, 9009, 1, 2]), r.choice(["buy this now please", "Buy  this now please", "another thing entirely", "", None, f"text {i}"]), r.choice(["English", "es", "German", None]), r.choice(["p", "p", "q", None]),
        ))
    return out


TRAFFIC = "seq bigint, ts bigint, session_id string, user_ip string, user_agent string, country string, asn bigint, prompt string, language string, publisher_id string"


def test_stream_of_all_rules_agrees_with_batch(spark, tmp_path):
    cfg = RuleConfig(session_burst_max=3, publisher_burst_max=40, volume_min=8, volume_ratio=2.0, rate_min=5, geo_min=3)
    df = spark.createDataFrame(_traffic(), TRAFFIC)
    for k, (lo, hi) in enumerate(((0, 90), (90, 180), (180, 999))):  # three files, taken one by one in order
        df.where(f"seq >= {lo} and seq < {hi}").coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        part = next((tmp_path / f"part{k}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{k}.parquet")
        stream = spark.readStream.schema(TRAFFIC).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = detector.detect_stream(stream, str(tmp_path / "between"), str(tmp_path / "out"), str(tmp_path / "check"), cfg)
    got = {r.seq: (r.score, r.verdict, sorted(r.reasons)) for r in out.collect()}
    want = {r.seq: (r.score, r.verdict, sorted(r.reasons)) for r in rules.detect(df, cfg).collect()}
    assert len(got) == out.count() == len(want) and got == want
    assert len({x for _, _, rs in want.values() for x in rs}) >= 15


def test_out_of_order_events_are_seen_as_they_arrive():
    """An event of an earlier time sees later ones kept, and does not bring back what a later one outdated."""
    s = detector.SessionState(RuleConfig(session_burst_max=2))
    e = lambda ts: {"ts": ts, "user_ip": "", "country": "", "asn": "", "user_agent": "", "prompt": ""}
    assert s.reasons(e(0)) == [] and s.reasons(e(200_000)) == []
    assert s.reasons(e(1_000)) == []  # the event at 0 is gone, the one at 200,000 is seen
    assert s.reasons(e(2_000)) == ["session_burst"]
    again = detector.SessionState(RuleConfig(session_burst_max=2), s.save())
    assert again.reasons(e(2_500)) == ["session_burst"]


def test_routed_stream_and_dedup(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text('{"req_id": "a"}\n{"req_id": "a"}\n{"req_id": "b"}\n')
    s = readers.line_stream(spark, str(src), "raw").withColumn("t", F.current_timestamp())
    q = detector.deduplicated(s.withColumn("req_id", F.get_json_object("value", "$.req_id")), "req_id", "t", "1 hour").select("topic", "value")
    q.writeStream.foreachBatch(writers.routed(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).where("topic = 'raw'").count() == 2


def _flat(rows):
    return rows.select(F.xxhash64("event.req_id").alias("seq"), (F.unix_micros(F.to_timestamp("event.event_time")) / 1000).cast("bigint").alias("ts"), "event.request_context.*", "event.optional_context.*", "event.publisher_id", "event.prompt", "event.language", "event.req_id")


def test_attack_families(spark):
    farm = attacks.INJECTORS["session_farm"](spark)
    assert farm.count() == 2000 and farm.groupBy("event.request_context.session_id").count().where("count <> 4").count() == 0
    assert {(r.attack_id, r.injected, r.source_req_id, r.publisher_profile in ("fully_abusive", "mildly_abusive")) for r in farm.collect()} == {("session_farm_001", True, "source", True)}
    cadence = _flat(attacks.INJECTORS["regular_cadence"](spark)).where("req_id like 'regular_cadence_0001_%'").orderBy("ts").collect()
    assert [b.ts - a.ts for a, b in zip(cadence, cadence[1:])] == [2000] * 3
    rows = {n: _flat(f(spark)).collect() for n, f in attacks.INJECTORS.items()}
    for name, (sessions, (fewest, most), _, (low, high)) in config.ATTACKS.items():
        by = {}
        for r in rows[name]:
            by.setdefault(r.session_id, []).append(r.ts)
        assert len(by) == sessions and all(fewest <= len(v) <= most for v in by.values())
        first = [sorted(v)[1] - sorted(v)[0] for v in by.values() if len(v) > 1 and fewest == most]
        assert all(g <= high * 1000 * (most - 1) + 1 for g in first)
    span = [r.ts for r in rows["slow_distributed_abuse"]]
    assert 5 * 3_600_000 < max(span) - min(span) < 6.1 * 3_600_000 and 1500 < len(span) < 2100
    from gatewarden.operators.rules import geo_language_mismatch

    assert _flat(attacks.INJECTORS["geo_mismatch"](spark)).where(geo_language_mismatch()).count() > 700
    ip = spark.range(50).select(attacks.synthetic_ip(F.col("id").cast("string"), F.lit("US")).alias("ip")).collect()
    assert all(int(r.ip.split(".")[0]) in config.FIRST_OCTETS and int(r.ip.split(".")[3]) >= 1 for r in ip)
    assert spark.range(1).select(attacks.weighted_pick(["a", "b"], [1.0, 0.0], F.lit("x"))).first()[0] == "a"


def test_attacks_copy_a_source_row(spark):
    turns = spark.createDataFrame([(f"c{i}", None, 0, f"prompt {i}", "de", "German", "UA", "2024-05-01T00:00:00Z") for i in range(30)] + [(None, None, 0, "x", None, None, None, None), ("c1", "h", 1, " ", None, None, None, None), ("c1", "h", 2, "again", None, None, None, "soon")], "conversation_id string, hashed_ip string, turn int, content string, country string, language string, user_agent string, timestamp string")
    clean = attacks.clean_rows(turns).collect()
    assert len(clean) == 31 and {r.publisher_profile for r in clean} <= set(config.PUBLISHERS.values())
    assert len({r.event.publisher_id for r in clean if r.event.request_context.session_id == "c1"}) == 1
    last = next(r for r in clean if r.event.prompt == "again")
    assert (last.event.optional_context.country, last.event.language, last.event.event_time) == ("US", "unknown", "2023-01-01T00:00:00+00:00") and last.event.request_context.user_agent in config.USER_AGENTS
    both = attacks.with_attacks(attacks.clean_rows(turns, limit=5), "ua_rotation")
    got = both.where("injected").select("source_req_id", "event.prompt", "event.optional_context.country", "event.request_context.user_agent").collect()
    assert len(got) == 1200 and len({r.source_req_id for r in got}) == 1 and {r.country for r in got} == {"DE"} and {r.user_agent for r in got} == set(config.ROTATING_AGENTS)
    assert attacks.with_attacks(clean and attacks.clean_rows(turns.limit(0)), "regular_cadence").count() == 800


def test_splits_keep_sessions_and_meet_the_targets(spark):
    df = spark.range(4000).select((F.col("id") % 700).cast("string").alias("s")).unionByName(spark.range(3).select(F.lit(None).cast("string").alias("s")))
    out = attacks.session_splits(df, "s")
    assert out.count() == 4003 and out.groupBy("s").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    got = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert abs(got["train"] - 2800) <= 6 and abs(got["validation"] - 600) <= 6


def test_first_non_empty(spark):
    df = spark.createDataFrame([(None, " ", "x"), (float("nan"), "y", "x"), (None, None, None)], "a double, b string, c string")
    assert [r[0] for r in df.select(first_non_empty(F.col("a"), F.col("b"), F.col("c"), default="d")).collect()] == ["x", "y", "d"]


def test_turns(spark):
    conv = "array<struct<role: string, content: string>>"
    df = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "x"), (None, "yo"), ("user", " ")], "own"), (2, [], "b"), (3, None, "c"), (4, None, None)], f"i int, conversation {conv}, p string")
    assert [(r.i, r.turn, r.content) for r in events.turns(df, "conversation").orderBy("i", "turn").collect()] == [(1, 0, "hi"), (1, 2, "yo")]
    assert [(r.i, r.turn, r.content) for r in events.turns(df, "conversation", "p").orderBy("i", "turn").collect()] == [(1, 0, "hi"), (1, 2, "yo"), (2, 0, "b"), (3, 0, "c")]


def test_messages_are_unwrapped_and_read(spark):
    inner = {"req_id": "r", "prompt": "p", "fraud": {"verdict": "fraud", "score": 0.9, "reasons": ["x"]}}
    df = events.parse_json(spark.createDataFrame([("requests.fraud", json.dumps({"req_id": "r", "request": inner})), ("requests.clean", json.dumps(inner)), ("requests.fraud", json.dumps({"req_id": "q"}))], "topic string, value string"), "value")
    got = df.withColumn("event", events.feature_event(F.col("topic"))).select(events.enriched().alias("e")).collect()
    assert [(r.e.request.req_id, r.e.fraud.verdict, r.e.fraud.score, r.e.fraud.reasons, r.e.moderation.method) for r in got] == [("r", "fraud", 0.9, ["x"], "tfidf_gate")] * 2 + [("q", "clean", 0.0, [], "tfidf_gate")]
    h = spark.createDataFrame([('{"User-Agent": "A"}',), ('{"user-agent": "B", "User-Agent": "A"}',), ("x",), (None,)], "h string")
    assert [r[0] for r in h.select(events.header_value(F.col("h"), "user-agent", "User-Agent")).collect()] == ["A", "B", None, None]


def test_cells_and_times(spark):
    from gatewarden.functions.times import iso_text

    df = spark.createDataFrame([('[{"role": "user"}]', "2024-03-01 02:00:00+02:00"), ("text", "soon"), ("{bad", None), (None, "2024-03-01")], "c string, t string")
    got = df.select(F.try_variant_get(events.maybe_json(F.col("c")), "$[0].role", "string").alias("r"), iso_text(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("user", "2024-03-01T00:00:00+00:00"), (None, "2023-01-01T00:00:00+00:00"), (None, "2023-01-01T00:00:00+00:00"), (None, "2024-03-01T00:00:00+00:00")]
