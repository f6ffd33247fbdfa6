"""Queries of the rules, windows, envelopes, history and metrics on the request tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden import config
from gatewarden.config import RuleConfig
from gatewarden.datagen import attacks
from gatewarden.functions.text import clean_id, first_non_empty, hex_prefix, or_unknown
from gatewarden.functions.times import iso_timestamp
from gatewarden.operators import evaluate, events, features, history, moderation, rules
from gatewarden.tables import table

#: The requests come minutes apart, so windows are stretched and thresholds lowered.
CFG = RuleConfig(scale=60.0, session_burst_max=4, publisher_burst_max=20, volume_min=8, volume_ratio=2.0, rate_min=5, cadence_drift_ms=120_000, ip_burst_max=3, country_max=1, geo_min=2)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Flat requests with trimmed keys (null if blank) and event time in milliseconds."""
    r = table(spark, folder, "raw_requests")
    return r.select(
        F.col("delivery_id").alias("seq"), F.unix_millis(iso_timestamp(F.col("event_time"))).alias("ts"), "event_time", clean_id(F.col("req_id")).alias("req_id"), "prompt", "language",
        clean_id(F.col("request_context.session_id")).alias("session_id"), F.col("request_context.user_agent").alias("user_agent"), F.col("request_context.user_ip").alias("user_ip"),
        F.col("optional_context.country").alias("country"), F.col("optional_context.asn").alias("asn"), clean_id(F.col("publisher_id")).alias("publisher_id"),
    )


def moderated(spark: SparkSession, folder: str) -> DataFrame:
    """Routed events with the label of their request; duplicate rows made one by content."""
    m = table(spark, folder, "moderated_requests").select(
        clean_id(F.col("req_id")).alias("req_id"), "flink_topic", F.col("fraud.score").alias("score"), F.col("fraud.verdict").alias("verdict"), F.col("fraud.reasons").alias("reasons"), clean_id(F.col("publisher_id")).alias("publisher_id"), "event_time"
    )
    return m.withColumnRenamed("flink_topic", "topic")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labeled_requests").select(clean_id(F.col("event.req_id")).alias("req_id"), "is_fraud", "attack_type", F.col("event.optional_context.asn").alias("asn"), F.col("event.request_context.user_ip").alias("user_ip"), F.col("event.request_context.session_id").alias("session_id"), F.col("event.prompt").alias("prompt"), clean_id(F.col("split")).alias("split"), "publisher_profile", "attack_id", F.col("event.event_time").alias("labelled_at"))


# ---- SQL parts ----

S = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
ID = lambda c: f"nullif(lower({S(c)}), '')"
REQ = f"""req as (select delivery_id as seq, event_time,
  epoch_ms(case when regexp_matches(trim(event_time), '^\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d(:\\d\\d(\\.\\d+)?)?(Z|[+-]\\d\\d:?\\d\\d)?$')
     then try_cast(replace(trim(event_time), ' ', 'T') || case when regexp_matches(trim(event_time), '(Z|[+-]\\d\\d:?\\d\\d)$') then '' else 'Z' end as timestamptz) end) as ts,
  {ID('req_id')} as req_id, prompt, language, {ID('request_context.session_id')} as session_id, request_context.user_agent as user_agent, request_context.user_ip as user_ip,
  optional_context.country as country, optional_context.asn as asn, {ID('publisher_id')} as publisher_id from raw_requests)"""
MOD = f"mod as (select {ID('req_id')} as req_id, flink_topic as topic, fraud.score as score, fraud.verdict as verdict, fraud.reasons as reasons, {ID('publisher_id')} as publisher_id, event_time from moderated_requests)"
LAB = f"lab as (select {ID('event.req_id')} as req_id, is_fraud, attack_type, event.optional_context.asn as asn, event.request_context.user_ip as user_ip, event.request_context.session_id as session_id, event.prompt as prompt, {ID('split')} as split, publisher_profile from labeled_requests)"
ms = CFG.ms


def _seen(key: str, value: str, window: int, out: str) -> str:
    """Self join: distinct values of the key's window."""
    return f"""(select count(distinct {value.replace('r.', 'b.')}) from req b where b.{key} = r.{key} and b.ts >= r.ts - {window} and (b.ts, b.seq) <= (r.ts, r.seq)) as {out}"""


def _count(key: str, window: int, out: str, cond: str = "true") -> str:
    return f"""(select count(*) from req b where b.{key} = r.{key} and b.ts >= r.ts - {window} and (b.ts, b.seq) <= (r.ts, r.seq) and {cond}) as {out}"""


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- projections and scalar functions ----


@query(f"with {REQ} select seq, ts from req where ts is not null")
def event_epoch_ms(spark, folder):
    return requests(spark, folder).select("seq", "ts").where("ts is not null")


@query(f"select delivery_id as seq, coalesce(nullif({S('request_context.session_id')}, ''), 'unknown_session') as session_key, coalesce(nullif({S('publisher_id')}, ''), 'unknown_publisher') as publisher_key, coalesce(nullif({S('request_context.user_ip')}, ''), 'unknown_ip') as ip_key from raw_requests")
def key_extract(spark, folder):
    r = table(spark, folder, "raw_requests")
    return r.select(F.col("delivery_id").alias("seq"), or_unknown(F.col("request_context.session_id"), "session").alias("session_key"), or_unknown(F.col("publisher_id"), "publisher").alias("publisher_key"), or_unknown(F.col("request_context.user_ip"), "ip").alias("ip_key"))


def _as_json(spark, folder):
    """Requests as JSON messages, some of them damaged, as the parser meets them."""
    r = table(spark, folder, "raw_requests")
    body = F.to_json(F.struct("event_time", "req_id", "prompt", "language", "request_context", "optional_context", "publisher_id"))
    value = F.when(F.col("delivery_id") % 50 == 0, F.substring(body, 1, 30)).when(F.col("delivery_id") % 50 == 1, F.lit("[1]")).otherwise(body)
    return r.select(F.col("delivery_id").alias("seq"), value.alias("value"))


@query("select delivery_id as seq, case when delivery_id % 50 = 0 then 'invalid_json' when delivery_id % 50 = 1 then 'invalid_event_type' end as parse_error, case when delivery_id % 50 > 1 then coalesce(req_id, '') end as req_id, case when delivery_id % 50 > 1 then coalesce(request_context.session_id, '') end as session_id, case when delivery_id % 50 > 1 then optional_context.asn end as asn from raw_requests")
def parse_events(spark, folder):
    p = events.parse_json(_as_json(spark, folder), "value").withColumn("q", F.when(F.col("parse_error").isNull(), events.raw_request()))
    return p.select("seq", "parse_error", "q.req_id", F.col("q.request_context.session_id").alias("session_id"), F.col("q.optional_context.asn").alias("asn"))


@query("select delivery_id as seq, 'fraud' as verdict, 1.0::double as score, 'invalid_event_type' as reason, '[1]' as raw from raw_requests where delivery_id % 50 = 1")
def parse_error_envelope(spark, folder):
    p = events.parse_json(_as_json(spark, folder), "value").where("parse_error = 'invalid_event_type'").withColumn("e", events.parse_error_envelope(F.col("value"), F.col("parse_error")))
    return p.select("seq", "e.verdict", "e.score", F.col("e.reasons")[0].alias("reason"), "e.request.raw")


@query(f"select delivery_id as seq from raw_requests where coalesce(req_id, '') <> '' and coalesce(prompt, '') <> ''")  # noqa: F541
def publishable_filter(spark, folder):
    return table(spark, folder, "raw_requests").where(events.publishable(F.col("req_id"), F.col("prompt"))).select(F.col("delivery_id").alias("seq"))


@query(f"select delivery_id as seq, coalesce(nullif({S('publisher_id')}, ''), nullif({S('request_context.session_id')}, ''), 'none') as v from raw_requests")
def first_non_empty_value(spark, folder):
    return table(spark, folder, "raw_requests").select(F.col("delivery_id").alias("seq"), first_non_empty(F.col("publisher_id"), F.col("request_context.session_id"), default="none").alias("v"))


@query("select doc_id, substr(sha256(concat_ws('|', source, cast(doc_id as varchar))), 1, 16) as h from documents")
def stable_req_id(spark, folder):
    return table(spark, folder, "documents").select("doc_id", hex_prefix(16, F.col("source"), F.col("doc_id").cast("string")).alias("h"))


@query(f"""with d as (select doc_id, sha256('US:' || cast(doc_id as varchar)) as h from documents), b as (select doc_id, ('0x' || substr(h,1,2))::int as a, ('0x' || substr(h,3,2))::int as b, ('0x' || substr(h,5,2))::int as c, ('0x' || substr(h,7,2))::int as d from d)
  select doc_id, concat_ws('.', {list(config.FIRST_OCTETS)}[a % 17 + 1], b, c, greatest(d, 1)) as ip from b""")
def synthetic_ip(spark, folder):
    return table(spark, folder, "documents").select("doc_id", attacks.synthetic_ip(F.col("doc_id").cast("string"), F.lit("US")).alias("ip"))


@query("select doc_id, 84000 - 4000 - 10000 + ('0x' || substr(sha256(cast(doc_id as varchar) || '|US'), 1, 6))::int % 900 as asn from documents")
def synthetic_asn(spark, folder):
    return table(spark, folder, "documents").select("doc_id", attacks.synthetic_asn(F.col("doc_id").cast("string"), F.lit("US")).alias("asn"))


# ---- stateless rules ----


#: The default pattern and numbers, and some that the data hold, so that the rules fire.
PATTERN = config.NEGATIVE_PROMPT + r"|\b(horrible|awful|shut up|keep the tone calm)\b"
ASNS = config.RISKY_ASNS + (64604, 65004)


@query(f"with {REQ} select seq from req where regexp_matches(coalesce(prompt, ''), '(?i){PATTERN}')")
def rule_negative_prompt(spark, folder):
    return requests(spark, folder).where(rules.negative_prompt(PATTERN)).select("seq")


@query(f"with {REQ} select seq from req where regexp_matches(coalesce(user_agent, ''), '(?i){config.BAD_USER_AGENT}')")
def rule_bad_user_agent(spark, folder):
    return requests(spark, folder).where(rules.bad_user_agent()).select("seq")


@query(f"with {REQ} select seq from req where asn in {ASNS}")
def rule_asn_risk(spark, folder):
    return requests(spark, folder).where(rules.asn_risk(ASNS)).select("seq")


_PAIRS = ", ".join(f"('{k}', '{c}')" for k, v in config.LANGUAGE_COUNTRIES.items() for c in v)
_ALIAS = ", ".join(f"('{k}', '{v}')" for k, v in config.LANGUAGE_ALIASES.items())


@query(f"""with {REQ}, p(l, c) as (values {_PAIRS}), al(a, n) as (values {_ALIAS}),
  x as (select seq, coalesce(al.n, lower({S('language')})) as l, upper({S('country')}) as c from req left join al on al.a = lower({S('language')}))
  select seq from x where l <> 'english' and l in (select l from p) and c in (select c from p) and not exists (select 1 from p where p.l = x.l and p.c = x.c)""")
def rule_geo_mismatch(spark, folder):
    return requests(spark, folder).where(rules.geo_language_mismatch()).select("seq")


# ---- look-back windows ----


@query(f"""with {REQ}, x as (select seq, ts, session_id, {_count('session_id', ms('session_burst_s'), 'n_session')},
   {_seen('session_id', f"nullif({S('r.user_ip')}, '')", ms('churn_s'), 'n_ip')}, {_seen('session_id', f"nullif(upper({S('r.country')}), '')", ms('churn_s'), 'n_country')},
   {_seen('session_id', 'r.asn', ms('churn_s'), 'n_asn')}, {_seen('session_id', f"nullif({S('r.user_agent')}, '')", ms('churn_s'), 'n_ua')} from req r where session_id is not null and ts is not null)
  select seq, n_session, n_ip, n_country, n_asn, n_ua from x""")
def session_windows(spark, folder):
    return rules.session_signals(requests(spark, folder), CFG).where("session_id is not null and ts is not null").select("seq", "n_session", "n_ip", "n_country", "n_asn", "n_ua")


def _session_rule(name: str, sql_condition: str, parts: str):
    def f(spark, folder):
        return rules.session_signals(requests(spark, folder), CFG).where(name).select("seq")

    f.__name__ = name
    query(f"with {REQ}, x as (select r.*, {parts} from req r where session_id is not null and ts is not null) select seq from x where {sql_condition}")(f)


_session_rule("session_burst", f"n > {CFG.session_burst_max}", _count("session_id", ms("session_burst_s"), "n"))
_session_rule("session_ip_churn", f"n >= {CFG.churn_min} and {S('user_ip')} <> ''", _seen("session_id", f"nullif({S('r.user_ip')}, '')", ms("churn_s"), "n"))
_session_rule("session_country_hop", f"n > {CFG.country_max} and {S('country')} <> ''", _seen("session_id", f"nullif(upper({S('r.country')}), '')", ms("churn_s"), "n"))
_session_rule("session_asn_churn", f"n >= {CFG.churn_min} and asn is not null", _seen("session_id", "r.asn", ms("churn_s"), "n"))
_session_rule("session_ua_churn", f"n >= {CFG.churn_min} and {S('user_agent')} <> ''", _seen("session_id", f"nullif({S('r.user_agent')}, '')", ms("churn_s"), "n"))


@query(f"""with {REQ}, x as (select seq, ts, lag(ts, 1) over w as a, lag(ts, 2) over w as b, lag(ts, 3) over w as c from req where session_id is not null and ts is not null window w as (partition by session_id order by ts, seq))
  select seq from x where c >= ts - {ms('cadence_s')} and least(ts - a, a - b, b - c) > 0 and greatest(ts - a, a - b, b - c) - least(ts - a, a - b, b - c) <= {CFG.cadence_drift_ms}""")
def regular_cadence(spark, folder):
    return rules.session_signals(requests(spark, folder), CFG).where("regular_cadence").select("seq")


@query(f"""with {REQ}, p as (select *, nullif(lower(trim(regexp_replace(prompt, '[\\s\\x{{a0}}\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))), '') as q from req where session_id is not null and ts is not null)
  select seq from p r where q is not null and exists (select 1 from p b where b.session_id = r.session_id and b.q = r.q and b.ts >= r.ts - {ms('replay_s')} and (b.ts, b.seq) < (r.ts, r.seq))""")
def prompt_replay_exact(spark, folder):
    return rules.with_prompt_replay(requests(spark, folder), CFG, exact=True).where("prompt_replay").select("seq")


@query()
def prompt_replay_fuzzy(spark, folder):
    return rules.with_prompt_replay(requests(spark, folder), CFG).where("prompt_replay").select("seq")


_BAD = f"(regexp_matches(coalesce({S('b.user_agent')}, ''), '(?i){config.BAD_USER_AGENT}') or coalesce({S('b.user_agent')}, '') = '')"
_PUB = f"""with {REQ}, x as (select r.*, {_count('publisher_id', ms('publisher_burst_s'), 'n_burst')}, {_count('publisher_id', ms('rate_s'), 'n_rate')}, {_count('publisher_id', ms('dispersion_s'), 'n_long')},
  {_count('publisher_id', ms('rate_s'), 'n_bad', _BAD)}, {_seen('publisher_id', f"coalesce({S('r.user_ip')}, '')", ms('dispersion_s'), 'n_ip_long')}, {_seen('publisher_id', f"coalesce({S('r.user_ip')}, '')", ms('publisher_burst_s'), 'n_ip_short')},
  {_seen('publisher_id', f"nullif({S('r.prompt')}, '')", ms('prompt_s'), 'n_prompt')}, {_seen('publisher_id', f"nullif(upper({S('r.country')}), '')", ms('geo_s'), 'n_geo')},
  not exists (select 1 from req b where b.publisher_id = r.publisher_id and coalesce({S('b.user_ip')}, '') = coalesce({S('r.user_ip')}, '') and b.ts >= r.ts - {ms('dispersion_s')} and (b.ts, b.seq) < (r.ts, r.seq)) as new_ip,
  not exists (select 1 from req b where b.publisher_id = r.publisher_id and coalesce(b.session_id, '') = coalesce(r.session_id, '') and b.ts >= r.ts - {ms('dispersion_s')} and (b.ts, b.seq) < (r.ts, r.seq)) as new_session
  from req r where publisher_id is not null and ts is not null)"""


def _publisher(spark, folder):
    return rules.publisher_signals(requests(spark, folder).withColumn("session_flagged", F.lit(False)), CFG).where("publisher_id is not null and ts is not null")


@query(f"{_PUB} select seq, n_burst, n_rate, n_bad, n_ip_long, n_ip_short, n_prompt, n_geo, new_ip, new_session from x")
def publisher_windows(spark, folder):
    return _publisher(spark, folder).select("seq", "n_burst", "n_rate", "n_bad", "n_ip_long", "n_ip_short", "n_prompt", "n_geo", F.col("publisher_new_ip").alias("new_ip"), F.col("publisher_new_session").alias("new_session"))


def _publisher_rule(name: str, condition: str):
    def f(spark, folder):
        return _publisher(spark, folder).where(name).select("seq")

    f.__name__ = name
    query(f"{_PUB} select seq from x where {condition}")(f)


_publisher_rule("publisher_burst", f"n_burst > {CFG.publisher_burst_max}")
_publisher_rule("publisher_bad_ua_rate", f"n_rate >= {CFG.rate_min} and n_bad / n_rate > {CFG.rate_share}")
_publisher_rule("publisher_new_ip", "new_ip")
_publisher_rule("publisher_new_session", "new_session")
_publisher_rule("publisher_dispersed_farm", f"new_ip and new_session and n_ip_long / n_long > {CFG.farm_ratio}")
_publisher_rule("publisher_burst_volume", f"n_burst >= {CFG.volume_min} and n_burst / n_ip_short >= {CFG.volume_ratio}")
_publisher_rule("publisher_prompt_replay", f"n_prompt >= {CFG.prompt_min} and {S('prompt')} <> ''")
_publisher_rule("publisher_geo_diversity", f"n_geo >= {CFG.geo_min} and {S('country')} <> ''")
_RATE = RuleConfig(scale=600.0, rate_min=5, session_burst_max=1)


@query(f"""with {REQ}, f as (select r.*, session_id is not null and {_count('session_id', _RATE.ms('session_burst_s'), 'k').removesuffix(' as k')} > {_RATE.session_burst_max} as flagged from req r where ts is not null),
  x as (select r.seq, (select count(*) from f b where b.publisher_id = r.publisher_id and b.ts >= r.ts - {_RATE.ms('rate_s')} and (b.ts, b.seq) <= (r.ts, r.seq)) as n_rate,
    (select count(*) from f b where b.publisher_id = r.publisher_id and b.ts >= r.ts - {_RATE.ms('rate_s')} and (b.ts, b.seq) <= (r.ts, r.seq) and b.flagged) as n_flag from f r where publisher_id is not null)
  select seq, n_rate, n_flag from x where n_rate >= {_RATE.rate_min} and n_flag / n_rate > {_RATE.rate_share}""")
def publisher_suspicious_rate(spark, folder):
    """Publishers whose sessions burst: the flags are those of the session rule."""
    x = rules.session_signals(requests(spark, folder), _RATE).withColumn("session_flagged", F.coalesce("session_burst", F.lit(False)))
    return rules.publisher_signals(x, _RATE).where("publisher_suspicious_rate").select("seq", "n_rate", "n_flag")


_DEFAULT = RuleConfig()


@query(f"""with {REQ}, x as (select seq, ts, session_id, {_count('session_id', _DEFAULT.ms('session_burst_s'), 'n_session')},
   {_seen('session_id', f"nullif({S('r.user_ip')}, '')", _DEFAULT.ms('churn_s'), 'n_ip')}, {_seen('session_id', f"nullif(upper({S('r.country')}), '')", _DEFAULT.ms('churn_s'), 'n_country')},
   {_seen('session_id', 'r.asn', _DEFAULT.ms('churn_s'), 'n_asn')}, {_seen('session_id', f"nullif({S('r.user_agent')}, '')", _DEFAULT.ms('churn_s'), 'n_ua')} from req r where session_id is not null and ts is not null)
  select seq, n_session, n_ip, n_country, n_asn, n_ua, n_session > {_DEFAULT.session_burst_max} as session_burst from x""")
def session_windows_default(spark, folder):
    """The session windows with the rules' own parameters."""
    return rules.session_signals(requests(spark, folder)).where("session_id is not null and ts is not null").select("seq", "n_session", "n_ip", "n_country", "n_asn", "n_ua", "session_burst")


@query(f"""with {REQ}, x as (select r.*, {_count('publisher_id', _DEFAULT.ms('publisher_burst_s'), 'n_burst')}, {_count('publisher_id', _DEFAULT.ms('rate_s'), 'n_rate')}, {_count('publisher_id', _DEFAULT.ms('dispersion_s'), 'n_long')},
  {_seen('publisher_id', f"coalesce({S('r.user_ip')}, '')", _DEFAULT.ms('dispersion_s'), 'n_ip_long')}, {_seen('publisher_id', f"nullif({S('r.prompt')}, '')", _DEFAULT.ms('slow_prompt_s'), 'n_prompt_slow')} from req r where publisher_id is not null and ts is not null)
  select seq, n_burst, n_rate, n_long, n_ip_long, n_prompt_slow from x""")
def publisher_windows_default(spark, folder):
    """The publisher windows with the rules' own parameters."""
    x = rules.publisher_signals(requests(spark, folder).withColumn("session_flagged", F.lit(False)))
    return x.where("publisher_id is not null and ts is not null").select("seq", "n_burst", "n_rate", "n_long", "n_ip_long", "n_prompt_slow")


@query(f"with {REQ} select seq from (select r.*, {_seen('publisher_id', f'''nullif({S('r.prompt')}, '')''', ms('slow_prompt_s'), 'n')} from req r where publisher_id is not null and ts is not null) where n >= {CFG.slow_prompt_min} and {S('prompt')} <> ''")
def publisher_slow_prompt_replay(spark, folder):
    return _publisher(spark, folder).where("publisher_slow_prompt_replay").select("seq")


_TURN = RuleConfig(scale=600.0, rotation_min_requests=4, rotation_min_uas=2)


@query(f"""with {REQ}, u as (select seq, ts, publisher_id, nullif({S('user_agent')}, '') as ua from req where publisher_id is not null and ts is not null),
  w as (select r.seq, (select list(b.ua order by b.ts, b.seq) from u b where b.publisher_id = r.publisher_id and b.ua is not null and b.ts >= r.ts - {_TURN.ms('rotation_s')} and (b.ts, b.seq) <= (r.ts, r.seq)) as s from u r where ua is not null),
  k as (select seq, s, list_max(list_transform(list_distinct(s), lambda x: list_position(s, x)))::int as size, len(list_distinct(s)) as n from w)
  select seq from k where n >= {_TURN.rotation_min_uas} and len(s) >= {_TURN.rotation_min_requests} and len(s) // size >= 2
    and len(list_filter(range(1, (len(s) // size)::bigint), lambda i: s[i * size + 1 : (i + 1) * size] <> s[1 : size])) = 0""")
def publisher_ua_rotation(spark, folder):
    """User agents of a publisher that repeat in a cycle, as the rule is documented; as coded it never fires."""
    return rules.ua_rotations(requests(spark, folder), _TURN)


@query(f"with {REQ}, i as (select *, nullif({S('user_ip')}, '') as ip from req) select seq, n_ip_requests, n_ip_requests > {CFG.ip_burst_max} as ip_burst from (select r.seq, (select count(*) from i b where b.ip = r.ip and b.ts >= r.ts - {ms('ip_burst_s')} and (b.ts, b.seq) <= (r.ts, r.seq)) as n_ip_requests from i r where ip is not null and ts is not null)")
def ip_burst(spark, folder):
    return rules.ip_burst(requests(spark, folder), CFG).select("seq", "n_ip_requests", "ip_burst")


# ---- score, verdict, routing ----


@query()
def fraud_detection(spark, folder):
    """The whole pipeline: 22 rules, score, verdict, topic."""
    d = rules.detect(requests(spark, folder), CFG)
    return d.select("seq", "score", "verdict", F.array_join("reasons", ",").alias("reasons"), events.topic(F.col("verdict")).alias("topic"))


_STATELESS = f"""with {REQ}, p(l, c) as (values {_PAIRS}), al(a, n) as (values {_ALIAS}), y as (select req.*, coalesce(al.n, lower({S('language')})) as l, upper({S('country')}) as c from req left join al on al.a = lower({S('language')})),
  z as (select seq, req_id, case when regexp_matches(coalesce(prompt, ''), '(?i){PATTERN}') then 'negative_prompt' end as np, case when regexp_matches(coalesce(user_agent, ''), '(?i){config.BAD_USER_AGENT}') then 'bad_user_agent' end as a,
   case when asn in {ASNS} then 'asn_risk' end as ar,
   case when l <> 'english' and l in (select l from p) and c in (select c from p) and not exists (select 1 from p where p.l = y.l and p.c = y.c) then 'geo_language_mismatch' end as g from y),
  s as (select seq, req_id, least(case when np is null then 0 else 15 end + case when a is null then 0 else 30 end + case when ar is null then 0 else 20 end + case when g is null then 0 else 45 end, 100) as pts, concat_ws(',', np, a, ar, g) as reasons from z),
  v as (select seq, req_id, pts / 100.0 as score, reasons, case when pts >= 70 then 'fraud' when pts >= 30 then 'suspicious' else 'clean' end as verdict from s)"""


def _stateless(spark, folder):
    return rules.scored(rules.with_stateless(requests(spark, folder), PATTERN, ASNS), rules.STATELESS)


@query(f"{_STATELESS} select seq, cast(score as double) as score, verdict, reasons, 'requests.' || case verdict when 'suspicious' then 'sus' else verdict end as topic from v")
def stateless_verdict(spark, folder):
    return _stateless(spark, folder).select("seq", "score", "verdict", F.array_join("reasons", ",").alias("reasons"), events.topic(F.col("verdict")).alias("topic"))


@query(f"{_STATELESS} select 'requests.' || case verdict when 'suspicious' then 'sus' else verdict end as topic, count(*) as n from v group by 1")
def route_counts(spark, folder):
    return _stateless(spark, folder).groupBy(events.topic(F.col("verdict")).alias("topic")).agg(F.count("*").alias("n"))


_LINE = "'[flink-fraud] ' || upper(verdict) || ' req_id=' || req_id || ' score=' || printf('%.3f', score::double) || ' reasons=[' || case when reasons = '' then '' else '\"' || replace(reasons, ',', '\", \"') || '\"' end || '] -> requests.' || case verdict when 'suspicious' then 'sus' else verdict end"


@query(f"{_STATELESS} select seq, {_LINE} as line from v where req_id is not null")
def log_lines(spark, folder):
    d = _stateless(spark, folder).where("req_id is not null")
    return d.select("seq", events.log_line(F.col("verdict"), F.col("req_id"), F.col("score"), F.col("reasons"), events.topic(F.col("verdict"))).alias("line"))


@query(f"{_STATELESS} select verdict, count(*) as n, cast(round(avg(score), 6) as double) as avg_score from v where req_id is not null group by 1")
def log_round_trip(spark, folder):
    """Log lines read back by pattern."""
    from gatewarden.sources.readers import read_log

    lines = _stateless(spark, folder).where("req_id is not null").select(events.log_line(F.col("verdict"), F.col("req_id"), F.col("score"), F.col("reasons"), events.topic(F.col("verdict"))).alias("value"))
    return read_log(lines).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


@query(f"{_STATELESS} select seq, 'flink' as source, verdict, cast(score as double) as score, reasons, r.event_time as event_time from v join req r using (seq) where verdict = 'fraud'")
def blocked_envelope(spark, folder):
    d = _stateless(spark, folder).where("verdict = 'fraud'").withColumn("q", F.struct("event_time", "req_id", "publisher_id", "prompt"))
    d = d.withColumn("b", events.blocked(F.col("q"), F.lit("flink"), F.col("verdict"), F.col("score"), F.col("reasons")))
    return d.select("seq", "b.source", "b.verdict", "b.score", F.array_join("b.reasons", ",").alias("reasons"), "b.event_time")


@query("select count(*) as n from moderated_requests where lower(trim(fraud.verdict)) = 'suspicious'")
def suspicious_filter(spark, folder):
    return moderated(spark, folder).where(events.is_suspicious(F.col("verdict"))).agg(F.count("*").alias("n"))


# ---- history, rollups, metrics ----


@query(f"with {MOD}, {LAB} select mod.topic as topic, lab.is_fraud as is_fraud, count(*) as n from mod join lab using (req_id) group by 1, 2")
def label_join(spark, folder):
    joined = history.label_join(moderated(spark, folder), labels(spark, folder), "req_id", "labelled_at")
    return joined.groupBy("topic", "is_fraud").agg(F.count("*").alias("n"))


@query(f"with {MOD}, {LAB} select req_id from mod where req_id not in (select req_id from lab where req_id is not null) and req_id is not null")
def anti_exported(spark, folder):
    return history.not_exported(moderated(spark, folder).where("req_id is not null"), labels(spark, folder), "req_id").select("req_id")


@query(f"with {MOD}, {LAB} select coalesce(is_fraud, 0) as is_fraud, count(*) as n from mod left join lab using (req_id) group by 1")
def left_label_default(spark, folder):
    return history.with_default_label(moderated(spark, folder), labels(spark, folder), "req_id", "is_fraud").groupBy("is_fraud").agg(F.count("*").alias("n"))


@query(f"with {REQ} select req_id, min(seq) as seq from req where req_id is not null group by 1")
def dedup_first(spark, folder):
    return history.first_per_key(requests(spark, folder).where("req_id is not null").select("req_id", "seq"), "req_id", "seq").select("req_id", "seq")


@query(f"""with {REQ}, {LAB}, done as (select distinct req_id from req where seq % 7 = 0 and req_id is not null), x as (select seq, req_id, row_number() over (partition by req_id order by seq) as k from req)
  select case when x.req_id is null then 'no_req_id' when x.req_id in (select req_id from done) then 'already_exported' when k > 1 then 'duplicate_topic' when x.req_id not in (select req_id from lab where req_id is not null) then 'skipped_unlabeled' else 'exported' end as status, count(*) as n from x group by 1 union all select 'consumed', count(*) from req""")
def export_stats(spark, folder):
    r = requests(spark, folder).select("seq", "req_id")
    return history.export_status(r, labels(spark, folder), r.where("seq % 7 = 0"), "req_id", "seq")


@query(f"""with m as (select *, {ID('req_id')} as rid from moderated_requests), one as (select rid, flink_topic, fraud.score as score, fraud.reasons as reasons, publisher_id from m where rid is not null group by all),
  f as (select rid, min(flink_topic) as topic, count(*) as n from one group by 1), {LAB}
  select rid as req_id, topic, is_fraud, attack_type, attack_id, publisher_profile from f join lab on lab.req_id = rid""".replace("as publisher_profile", "as publisher_profile").replace("split, publisher_profile from", "split, publisher_profile, attack_id from"))
def export_rows(spark, folder):
    """The rows of the export: the first of each request that has a label, with the label (``exported_at`` left out, as it is the time of the run)."""
    m = moderated(spark, folder).where("req_id is not null").select("req_id", "topic")
    first = history.first_per_key(m, "req_id", "topic")
    rows = history.export_rows(first, labels(spark, folder).select("req_id", "is_fraud", "attack_type", "attack_id", "publisher_profile", "labelled_at"), "req_id", "labelled_at")
    return rows.select("req_id", "topic", "is_fraud", "attack_type", "attack_id", "publisher_profile")


def _joined(spark, folder):
    return history.label_join(moderated(spark, folder), labels(spark, folder), "req_id", "labelled_at").where("is_fraud is not null")


_J = f"with {MOD}, {LAB}, j as (select mod.*, lab.is_fraud, lab.attack_type, lab.asn, lab.user_ip, lab.session_id, lab.prompt from mod join lab using (req_id) where is_fraud is not null)"


@query(f"{_J} select user_ip, count(*) as requests_from_ip, round(avg(is_fraud::double), 6) as fraud_rate, round(avg(score), 6) as avg_shallow_fraud_score from j group by 1")
def ip_risk(spark, folder):
    return _r6(history.risk_rollup(_joined(spark, folder), "user_ip", "is_fraud", "score", ("requests_from_ip", "fraud_rate", "avg_shallow_fraud_score")))


@query(f"{_J} select publisher_id, count(*) as requests_from_publisher, round(avg(is_fraud::double), 6) as fraud_rate, round(avg(score), 6) as avg_shallow_fraud_score from j group by 1")
def publisher_risk(spark, folder):
    return _r6(history.risk_rollup(_joined(spark, folder), "publisher_id", "is_fraud", "score", ("requests_from_publisher", "fraud_rate", "avg_shallow_fraud_score")))


@query(f"{_J} select asn::double as asn, count(*) as requests_from_asn, round(avg(is_fraud::double), 6) as fraud_rate from j group by 1")
def asn_risk_scores(spark, folder):
    return _r6(history.risk_rollup(_joined(spark, folder).withColumn("asn", F.col("asn").cast("double")), "asn", "is_fraud", None, ("requests_from_asn", "fraud_rate")))


@query(f"{_J} select session_id, count(*) as requests_per_session, cast(sum(is_fraud) as bigint) as fraud_requests_per_session from j group by 1")
def session_risk(spark, folder):
    return history.session_rollup(_joined(spark, folder), "session_id", "is_fraud")


def _r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c != "asn" else F.col(c) for c, t in df.dtypes])


_M = "round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as tpr, round(case when fp + tn = 0 then 0 else fp / (fp + tn) end, 6) as fpr, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as prec, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy"
_C = "count_if(p and a) as tp, count_if(p and not a) as fp, count_if(not p and a) as fn, count_if(not p and not a) as tn"


@query(f"{_J}, c as (select {_C} from (select coalesce(score >= 0.5, false) as p, is_fraud = 1 as a from j)) select *, {_M} from c")
def confusion_metrics(spark, folder):
    return evaluate.confusion(_joined(spark, folder), F.col("score") >= 0.5, F.col("is_fraud") == 1)


@query(f"{_J}, c as (select topic, {_C} from (select topic, coalesce(score >= 0.5, false) as p, is_fraud = 1 as a from j where topic is not null) group by 1) select *, {_M} from c")
def per_topic_metrics(spark, folder):
    return evaluate.confusion(_joined(spark, folder).where("topic is not null"), F.col("score") >= 0.5, F.col("is_fraud") == 1, "topic")


@query(f"{_J} select attack_type, count(*) as n, round(avg(case when coalesce(score, 0) >= 0.5 then 1.0 else 0.0 end), 6)::double as tpr from j where is_fraud = 1 group by 1")
def per_attack_tpr(spark, folder):
    return _joined(spark, folder).where("is_fraud = 1").groupBy("attack_type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.coalesce("score", F.lit(0.0)) >= 0.5, 1.0).otherwise(0.0)), 6).alias("tpr"))


@query(f"with {LAB} select coalesce(cast(is_fraud as varchar), 'None') as value, count(*) as n from lab group by 1")
def class_balance(spark, folder):
    return history.count_by(labels(spark, folder), F.col("is_fraud"))


@query(f"with {LAB} select coalesce(split, 'None') as value, count(*) as n from lab group by 1")
def split_sizes(spark, folder):
    return history.count_by(labels(spark, folder), F.col("split"))


@query(f"with {LAB} select coalesce(publisher_profile, 'None') as value, count(*) as n from lab group by 1")
def count_by_profile(spark, folder):
    return history.count_by(labels(spark, folder), F.col("publisher_profile"))


@query(f"""{_J}, k as (select unnest([0, 1]) as v), c as (select v, count_if(p = v and is_fraud = v) as tp, count_if(p = v and is_fraud <> v) as fp, count_if(p <> v and is_fraud = v) as fn from (select case when coalesce(score, 0) >= 0.5 then 1 else 0 end as p, is_fraud from j), k group by 1),
  r as (select cast(v as varchar) as label, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as prec, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1, cast(tp + fn as bigint) as support from c)
  select * from r union all select 'macro', round(avg(prec), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) from r
  union all select 'weighted', round(sum(prec * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from r""")
def class_report(spark, folder):
    return evaluate.class_report(_joined(spark, folder).withColumn("p", (F.coalesce("score", F.lit(0.0)) >= 0.5).cast("int")), "p", "is_fraud")


SIGNS, BASE = config.SWEEP_REASONS, config.SWEEP_BASE
_MASK = " + ".join(f"case when list_contains(reasons, '{n}') then {1 << i} else 0 end" for i, n in enumerate(SIGNS))
_H = f"{_J}, h as (select cast(coalesce({_MASK}, 0) as bigint) as mask, count_if(is_fraud = 0) as clean, count_if(is_fraud = 1) as fraud from j group by 1)"


@query(f"{_H} select * from h")
def signature_histogram(spark, folder):
    return evaluate.signature_histogram(_joined(spark, folder), "reasons", "is_fraud", SIGNS)


_VARIED = list(config.SWEEP_VARY)
_W = ", ".join(f"w{i}" if i in config.SWEEP_VARY else str(BASE[i]) for i in range(len(SIGNS)))
_AXES = ", ".join(f"(select unnest({config.SWEEP_VARY[i]}) as w{i}, generate_subscripts({config.SWEEP_VARY[i]}, 1) as o{i})" for i in _VARIED)


@query(f"""{_H}, axes as (select *, list_value({_W}) as w from {_AXES}, (select unnest({config.SWEEP_SUSPICIOUS}) as sus, generate_subscripts({config.SWEEP_SUSPICIOUS}, 1) as os), (select unnest({config.SWEEP_FRAUD}) as fra, generate_subscripts({config.SWEEP_FRAUD}, 1) as of) where sus < fra),
  g as (select cast(row_number() over (order by {', '.join(f'o{i}' for i in _VARIED)}, os, of) - 1 as int) as config, w, sus, fra from axes),
  e as (select config, sus, fra, clean, fraud, least({' + '.join(f'((mask >> {i}) & 1) * w[{i + 1}]' for i in range(len(SIGNS)))}, 100) as points from h, g),
  s as (select config, sus, fra, cast(sum(case when points >= fra then fraud else 0 end) as bigint) as tp, cast(sum(case when points >= fra then clean else 0 end) as bigint) as fp, cast(sum(case when points < sus then fraud else 0 end) as bigint) as fn,
   cast(sum(case when points >= sus and points < fra then fraud else 0 end) as bigint) as sus_fraud, cast(sum(case when points >= sus and points < fra then clean else 0 end) as bigint) as sus_clean, sum(fraud) as nf, sum(clean) as nc from e group by 1, 2, 3)
  select config, sus, fra, tp, fp, fn, sus_fraud, sus_clean, round(case when nf = 0 then 0 else tp / nf end, 6)::double as tpr, round(case when nc = 0 then 0 else fp / nc end, 6)::double as fpr, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6)::double as prec
  from s order by tpr desc, fp, sus_clean, config limit 40""")
def threshold_sweep_top40(spark, folder):
    """25,920 configurations over the signatures."""
    hist = evaluate.signature_histogram(_joined(spark, folder), "reasons", "is_fraud", SIGNS)
    return evaluate.best(evaluate.sweep(hist, evaluate.weight_grid(BASE, config.SWEEP_VARY, config.SWEEP_SUSPICIOUS, config.SWEEP_FRAUD)))


_GRID = evaluate.weight_grid(BASE, {11: [15, 50], 3: [15, 35]}, [35, 45], [50, 70])
_POINTS = " + ".join(f"((mask >> {i}) & 1) * w[{i + 1}]" for i in range(len(SIGNS)))


@query(f"""{_H}, g(config, w, sus, fra) as (values {', '.join(f'({i}, {w}, {s}, {f})' for i, (w, s, f) in enumerate(_GRID))}), e as (select config, sus, fra, clean, fraud, least({_POINTS}, 100) as points from h, g),
  s as (select config, sus, fra, cast(sum(case when points >= fra then fraud else 0 end) as bigint) as tp, cast(sum(case when points >= fra then clean else 0 end) as bigint) as fp, cast(sum(case when points < sus then fraud else 0 end) as bigint) as fn,
   cast(sum(case when points >= sus and points < fra then fraud else 0 end) as bigint) as sus_fraud, cast(sum(case when points >= sus and points < fra then clean else 0 end) as bigint) as sus_clean, sum(fraud) as nf, sum(clean) as nc from e group by 1, 2, 3)
  select config, sus, fra, tp, fp, fn, sus_fraud, sus_clean, round(case when nf = 0 then 0 else tp / nf end, 6)::double as tpr, round(case when nc = 0 then 0 else fp / nc end, 6)::double as fpr, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6)::double as prec from s""")
def threshold_sweep_small(spark, folder):
    return evaluate.sweep(evaluate.signature_histogram(_joined(spark, folder), "reasons", "is_fraud", SIGNS), _GRID)


# ---- moderation, features, model ----

_TERMS = ("search panel", "night desk", "standing desk", "shown times", "link offer", "score of")
_WORDS = {"DESK": ("standing desk", "folding desk lamp", "night desk"), "FEED": ("partner feed", "news digest"), "NSFW": ("nude", "porn")}


def _normalized(spark, folder):
    """All documents; SQL has no compatibility form, so the four queries on it are tested against brute force."""
    return moderation.compatibility_form(table(spark, folder, "documents").select("doc_id", "text"), "text", "n").select("doc_id", "n")


@query()
def text_normalize(spark, folder):
    return _normalized(spark, folder)


@query()
def moderation_hits(spark, folder):
    return _normalized(spark, folder).select("doc_id", F.array_join(moderation.hits(F.col("n"), _TERMS), ",").alias("hits"))


@query()
def moderation_verdict(spark, folder):
    d = _normalized(spark, folder).withColumn("score", moderation.hit_score(moderation.hits(F.col("n"), _TERMS)))
    return d.select("doc_id", "score", F.when(F.col("score") >= 0.01, "unsafe").otherwise("clean").alias("verdict"))


@query()
def keyword_categories(spark, folder):
    d = _normalized(spark, folder).withColumn("c", moderation.categories(F.col("n"), _WORDS))
    return d.select("doc_id", F.array_join("c", ",").alias("categories"), moderation.category_score(F.col("c")).alias("score"))


def _messages(spark, folder):
    r = table(spark, folder, "raw_requests").withColumn("seq", F.col("delivery_id"))
    judged = moderation.moderate(r, "seq", "prompt", terms=_TERMS)
    own = F.struct("event_time", "req_id", "prompt", "language", "request_context", "optional_context", "publisher_id")
    return judged, own


@query()
def moderation_flow(spark, folder):
    """All requests through the moderation stage: messages per topic and outcome, as read back from their JSON."""
    judged, own = _messages(spark, folder)
    m = events.parse_json(moderation.moderation_messages(judged, own, version="v1"), "value").withColumn("e", events.enriched())
    v = F.when(F.col("topic") == config.TOPICS["fraud"], events.text_at("$.verdict")).otherwise(F.col("e.moderation.verdict"))
    return m.groupBy("topic", v.alias("verdict")).agg(F.count("*").alias("n"), F.count(F.nullif(F.try_variant_get("event", "$.req_id", "string"), F.lit(""))).alias("n_named"))


@query()
def tfidf_max_similarity(spark, folder):
    """Every delivery's prompt against the reference prompts and the bad terms."""
    ref = moderation.compatibility_form(table(spark, folder, "unsafe_reference"), "text", "n")
    prompts = moderation.compatibility_form(table(spark, folder, "raw_requests").select(F.col("delivery_id").alias("seq"), "prompt"), "prompt", "n")
    return moderation.max_similarity(prompts, "seq", "n", ref, "ref_id", "n", config.TERMS)


_F = f"coalesce(score, 0)::double as flink_fraud_score, coalesce(asn, 0)::double as asn, length(coalesce(prompt, ''))::double as prompt_length, regexp_matches(coalesce(prompt, ''), '(?i){config.SCAM_WORDS}')::int as contains_scam_keyword, coalesce(len(reasons), 0)::double as flink_reason_count, coalesce(list_has_any(reasons, {list(config.UA_REASONS)}), false)::int as has_user_agent_signal, coalesce(list_has_any(reasons, {list(config.BURST_REASONS)}), false)::int as has_burst_signal"


def _features(spark, folder):
    j = _joined(spark, folder)
    f = features.features(F.col("score"), F.col("asn"), F.col("prompt"), F.col("reasons"))
    return j.select("req_id", "topic", F.col("is_fraud").cast("int").alias("is_fraud"), *[c.alias(n) for n, c in f.items()])


@query(f"{_J} select req_id, topic, is_fraud, {_F} from j")
def rfc_features(spark, folder):
    return _features(spark, folder)


@query()
def rf_train_score(spark, folder):
    rows = history.first_per_key(_features(spark, folder).where("req_id is not null"), "req_id", "topic", *features.COLUMNS, "is_fraud")
    marked = history.stratified_split(rows, "req_id", "is_fraud")
    model = features.train(marked.where("is_train"))
    scored = features.score(model, marked.where("not is_train"))
    return evaluate.confusion(scored, F.col("model_verdict") == "fraud", F.col("is_fraud") == 1)


@query()
def scoring_flow(spark, folder):
    """Suspicious events through the forest: messages per topic and verdict of the model, as read back from their JSON."""
    model = features.train(history.first_per_key(_features(spark, folder).where("req_id is not null"), "req_id", "topic", *features.COLUMNS, "is_fraud"))
    m = table(spark, folder, "moderated_requests").where(events.is_suspicious(F.col("fraud.verdict"))).join(labels(spark, folder).select(F.col("req_id").alias("id"), "asn", "prompt"), F.col("id") == clean_id(F.col("req_id")))
    x = m.select(F.struct("event_time", "req_id", "publisher_id", "prompt", "fraud").alias("q"), *[c.alias(n) for n, c in features.features(F.col("fraud.score"), F.col("asn"), F.col("prompt"), F.col("fraud.reasons")).items()])
    out = features.score_messages(features.score(model, x), F.col("q"), "v1")
    e = events.parse_json(out, "value")
    return e.groupBy("topic", events.text_at("$.verdict", default=None).alias("blocked_verdict")).agg(F.count("*").alias("n"))


@query(f"""with {LAB}, x as (select req_id, is_fraud, row_number() over (partition by is_fraud order by sha256(req_id || '|42'), req_id) as k, count(*) over (partition by is_fraud) as n from lab where req_id is not null)
  select req_id, n < 2 or k <= floor(0.8 * n) as is_train from x""")
def stratified_split(spark, folder):
    return history.stratified_split(labels(spark, folder).where("req_id is not null").select("req_id", "is_fraud"), "req_id", "is_fraud").select("req_id", "is_train")


# ---- data generation, sets, order ----


_HEX = lambda text, n: f"('0x' || substr(sha256({text}), 1, {n}))::bigint"
_GROUPS = ", ".join(f"('{n}', {k}, {most})" for n, (k, (_, most), _, _) in config.ATTACKS.items())
_BASES = "case country " + " ".join(f"when '{c}' then {v}" for c, v in config.ASN_BASE.items()) + " else 90000 end"
_ATTACKS = f"""f(name, sessions, most) as (values {_GROUPS}), r as (select name, most, s, k from f, range(1200) a(s), range(100) b(k) where s < sessions and k < most),
  kept as (select * from r where name <> 'slow_distributed_abuse' or k < floor({_HEX("'1337|' || name || '|' || s || '|rows'", 8)} / 4294967296.0 * 2) + 1),
  named as (select *, substr(sha256(name || '_001:' || s), 1, 32) as session_id, case when name = 'geo_mismatch' then {[f"{a}|{b}" for a, b in config.MISMATCHES]}[({_HEX("'1337|' || name || '|' || s || '|' || k || '|pair'", 6)} % {len(config.MISMATCHES)})::int + 1] else 'English|US' end as pair from kept),
  there as (select *, split_part(pair, '|', 1) as language, split_part(pair, '|', 2) as country from named),
  h as (select *, sha256(country || ':' || session_id) as d from there)"""


@query(f"""with {_ATTACKS} select name as attack_type, name || '_' || lpad(s::varchar, 4, '0') || '_' || k as req_id, session_id, language, country,
   concat_ws('.', {list(config.FIRST_OCTETS)}[('0x' || substr(d, 1, 2))::int % {len(config.FIRST_OCTETS)} + 1], ('0x' || substr(d, 3, 2))::int, ('0x' || substr(d, 5, 2))::int, greatest(('0x' || substr(d, 7, 2))::int, 1)) as user_ip,
   cast({_BASES} + {_HEX("session_id || ':' || country", 6)} % 900 as bigint) as asn from h""")
def injected_families(spark, folder):
    """Rows of every attack family: identities, languages and countries."""
    rows = None
    for name in attacks.INJECTORS:
        part = attacks.INJECTORS[name](spark)
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("attack_type", "event.req_id", "event.request_context.session_id", "event.language", "event.optional_context.country", "event.request_context.user_ip", "event.optional_context.asn")


@query(f"with {REQ}, {_ATTACKS} select a as attack_type, n, sources from (select coalesce(attack_type, 'none') as a, count(*) as n, 0::bigint as sources from labeled_requests group by 1 union all select name, count(*), 1 from kept where name in ('regular_cadence', 'slow_distributed_abuse') group by 1)")
def union_clean_fraud(spark, folder):
    """Labelled rows and attacks modelled on one of them."""
    own = table(spark, folder, "labeled_requests").select("event", F.coalesce("attack_type", F.lit("none")).alias("attack_type"), F.lit(None).cast("string").alias("source_req_id"))
    return attacks.with_attacks(own, "regular_cadence", "slow_distributed_abuse").groupBy("attack_type", F.col("source_req_id").isNull().alias("real")).agg(F.count("*").alias("n"), F.count_distinct("source_req_id").alias("sources")).drop("real")


@query()
def attack_verdicts(spark, folder):
    """The 22 rules with their own parameters on the attack families modelled on a labelled row: requests and verdicts per family."""
    clean = table(spark, folder, "labeled_requests").select("event", "attack_type").where("attack_type = 'none'")
    rows = attacks.with_attacks(clean).where("attack_type <> 'none'").select("attack_type", "event.*")
    flat = rows.select(
        F.xxhash64("req_id").alias("seq"), F.unix_millis(iso_timestamp(F.col("event_time"))).alias("ts"), "req_id", "prompt", "language", clean_id(F.col("request_context.session_id")).alias("session_id"), F.col("request_context.user_agent").alias("user_agent"),
        F.col("request_context.user_ip").alias("user_ip"), F.col("optional_context.country").alias("country"), F.col("optional_context.asn").alias("asn"), clean_id(F.col("publisher_id")).alias("publisher_id"), "attack_type",
    )
    return rules.detect(flat).groupBy("attack_type", "verdict").agg(F.count("*").alias("n"))


_WEIGHTS = attacks.publisher_weights()
_CUTS = [sum(list(_WEIGHTS.values())[: i + 1]) / sum(_WEIGHTS.values()) for i in range(len(_WEIGHTS) - 1)]
_STICKY = "case " + " ".join(f"when place < {c!r} then '{p}'" for p, c in zip(_WEIGHTS, _CUTS)) + f" else '{list(_WEIGHTS)[-1]}' end"
_TURNS = "t as (select doc_id, publisher_id, unnest(string_split(replace(text, chr(13), ''), chr(10) || chr(10))) as c, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10) || chr(10)), 1) - 1 as turn from documents where doc_type = 'transcript' and text is not null)"


@query(f"""with {_TURNS}, u as (select doc_id::varchar as conv, turn, c from t where c like 'User: %' and trim(c) <> ''), p as (select *, {_HEX("'1337|' || conv", 8)} / 4294967296.0::double as place, sha256('US:' || conv) as d from u)
  select substr(sha256(conv || '|' || turn || '|' || c), 1, 32) as req_id, conv as session_id, {_STICKY} as publisher_id, {_HEX("conv || '|US'", 6)} % 900 + 70000 as asn,
   {list(config.USER_AGENTS)}[({_HEX("'1337|' || conv || '|' || turn", 6)} % {len(config.USER_AGENTS)})::int + 1] as user_agent,
   concat_ws('.', {list(config.FIRST_OCTETS)}[('0x' || substr(d, 1, 2))::int % {len(config.FIRST_OCTETS)} + 1], ('0x' || substr(d, 3, 2))::int, ('0x' || substr(d, 5, 2))::int, greatest(('0x' || substr(d, 7, 2))::int, 1)) as user_ip from p""")
def clean_rows(spark, folder):
    """Labelled clean rows built from the users' turns of the transcripts."""
    none = F.lit(None).cast("string")
    t = _turns(spark, folder).select(F.col("doc_id").cast("string").alias("conversation_id"), none.alias("hashed_ip"), "turn", "content", none.alias("country"), none.alias("language"), none.alias("user_agent"), F.col("created_at").cast("string").alias("timestamp"))
    return attacks.clean_rows(t).select("event.req_id", "event.request_context.session_id", "event.publisher_id", "event.optional_context.asn", "event.request_context.user_agent", "event.request_context.user_ip")


@query(f"""with {REQ}, n as (select session_id, count(*) as n, sha256(session_id || '|1337') as h from req where session_id is not null group by 1), c as (select *, sum(n) over (order by h, session_id) as e, sum(n) over () as total from n)
  select session_id, case when e <= floor(total * 0.7) then 'train' when e <= floor(total * 0.7) + floor(total * 0.15) then 'validation' else 'test' end as split from c""")
def session_splits(spark, folder):
    return attacks.session_splits(requests(spark, folder).select("session_id").where("session_id is not null"), "session_id").distinct()


@query(f"with {LAB} select distinct r as reason from (select unnest(fraud.reasons) as r from moderated_requests) where r is not null")
def distinct_reasons(spark, folder):
    return moderated(spark, folder).select(F.explode("reasons").alias("reason")).where("reason is not null").distinct()


@query(f"with {MOD} select req_id, event_time from mod where event_time is not null and req_id is not null group by all order by event_time desc, req_id limit 40")
def latest_events(spark, folder):
    m = moderated(spark, folder).where("event_time is not null and req_id is not null").select("req_id", "event_time").distinct()
    return m.orderBy(F.desc("event_time"), "req_id").limit(40)


@query(f"with {MOD} select req_id, array_to_string(list_filter(reasons, lambda x: x not in ('publisher_new_ip', 'publisher_new_session')), ',') as rest from mod where reasons is not null and req_id is not null")
def reasons_except(spark, folder):
    m = moderated(spark, folder).where("reasons is not null and req_id is not null")
    return m.select("req_id", F.array_join(F.array_except("reasons", F.array(F.lit("publisher_new_ip"), F.lit("publisher_new_session"))), ",").alias("rest"))


@query("select user_id, count(*) as n, count_if(event_type = 'error') as errors, round(avg(value), 6) as avg_value from events group by 1")
def user_event_rollup(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 6).alias("avg_value"))


def _turns(spark, folder):
    d = table(spark, folder, "documents").where("doc_type = 'transcript' and text is not null")
    parts = F.split(F.regexp_replace("text", "\r", ""), "\n\n")
    conv = F.transform(parts, lambda p: F.struct(F.when(p.startswith("User: "), "user").otherwise("assistant").alias("role"), p.alias("content")))
    return events.turns(d.withColumn("conversation", conv), "conversation")


@query(f"with {_TURNS} select doc_id, turn::int as turn, length(c) as n from t where c like 'User: %'")
def conversation_turns(spark, folder):
    """Transcripts cut into turns; those of the user."""
    return _turns(spark, folder).select("doc_id", "turn", F.length("content").alias("n"))


QUERIES, ORACLE = Q, SQL

