"""The look-back rules on a stream: arrival-order state per session, then per publisher, and deduplication within a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatewarden.config import RuleConfig
from gatewarden.functions.text import collapse_space, strip
from gatewarden.operators.events import topic
from gatewarden.operators.rules import PUBLISHER_RULES, SESSION_RULES, STATELESS, bad_user_agent, scored, similar, with_stateless


def _recent(times: list, values: list, least: int) -> tuple[list, list]:
    keep = [i for i, t in enumerate(times) if t >= least]
    return ([times[i] for i in keep], [values[i] for i in keep]) if len(keep) < len(times) else (times, values)


class Window:
    """Values of a key with their event times, in the order of arrival. An event outdates, for good, what is older than
    its own time less the window; later ones stay and are seen."""

    def __init__(self, times=(), values=()):
        self.times, self.values = [int(t) for t in times], list(values)

    def add(self, ts: int, value, window: int) -> list:
        """The values seen by an event at ``ts`` that has ``value``, its own last."""
        self.times, self.values = _recent(self.times, self.values, ts - window)
        self.times.append(ts)
        self.values.append(value)
        return self.values

    def seen(self, ts: int, window: int) -> list:
        self.times, self.values = _recent(self.times, self.values, ts - window)
        return self.values


class SessionState:
    """The session rules on events as they arrive."""

    PARTS = ("all", "ip", "country", "asn", "agent", "prompt")

    def __init__(self, cfg: RuleConfig, saved: tuple | None = None):
        self.cfg = cfg
        saved = saved or ((),) * (2 * len(self.PARTS))
        self.w = {n: Window(saved[2 * i] or (), saved[2 * i + 1] or ()) for i, n in enumerate(self.PARTS)}

    def save(self) -> tuple:
        return tuple(x for n in self.PARTS for x in (self.w[n].times, self.w[n].values))

    def reasons(self, e: dict) -> list[str]:
        c, ts, out = self.cfg, e["ts"], []
        self.w["all"].add(ts, "", c.ms("session_burst_s"))
        if len(self.w["all"].times) > c.session_burst_max:
            out.append("session_burst")
        last = [t for t in self.w["all"].times if t >= ts - c.ms("cadence_s")][-4:]
        gaps = [b - a for a, b in zip(last, last[1:])]
        if len(gaps) == 3 and min(gaps) > 0 and max(gaps) - min(gaps) <= c.cadence_drift_ms:
            out.append("regular_cadence")
        for name, value, rule, enough in (
            ("ip", e["user_ip"], "session_ip_churn", lambda n: n >= c.churn_min), ("country", e["country"], "session_country_hop", lambda n: n > c.country_max),
            ("asn", e["asn"], "session_asn_churn", lambda n: n >= c.churn_min), ("agent", e["user_agent"], "session_ua_churn", lambda n: n >= c.churn_min),
        ):
            if value and enough(len(set(self.w[name].add(ts, value, c.ms("churn_s"))))):
                out.append(rule)
        if e["prompt"] and similar(e["prompt"], self.w["prompt"].add(ts, e["prompt"], c.ms("replay_s"))[:-1], c.replay_ratio):
            out.append("prompt_replay")
        return out


class PublisherState:
    """The publisher rules on events as they arrive, after the session's."""

    PARTS = ("burst", "flags", "long", "ip", "session", "prompt", "country", "slow")

    def __init__(self, cfg: RuleConfig, saved: tuple | None = None):
        self.cfg = cfg
        saved = saved or ((),) * (2 * len(self.PARTS))
        self.w = {n: Window(saved[2 * i] or (), saved[2 * i + 1] or ()) for i, n in enumerate(self.PARTS)}

    save = SessionState.save

    def reasons(self, e: dict) -> list[str]:
        c, ts, out, w = self.cfg, e["ts"], [], self.w
        burst = w["burst"].add(ts, "", c.ms("publisher_burst_s"))
        if len(burst) > c.publisher_burst_max:
            out.append("publisher_burst")
        flags = w["flags"].add(ts, ("f" if e["flagged"] else "") + ("b" if e["bad_agent"] else ""), c.ms("rate_s"))
        if len(flags) >= c.rate_min and sum("f" in x for x in flags) / len(flags) > c.rate_share:
            out.append("publisher_suspicious_rate")
        if len(flags) >= c.rate_min and sum("b" in x for x in flags) / len(flags) > c.rate_share:
            out.append("publisher_bad_ua_rate")
        long = c.ms("dispersion_s")
        new_ip, new_session = e["user_ip"] not in w["ip"].seen(ts, long), e["session_id"] not in w["session"].seen(ts, long)
        ips = w["ip"].add(ts, e["user_ip"], long)
        w["session"].add(ts, e["session_id"], long)
        if new_ip:
            out.append("publisher_new_ip")
        if new_session:
            out.append("publisher_new_session")
        if new_ip and new_session and len(set(ips)) / len(w["long"].add(ts, "", long)) > c.farm_ratio:
            out.append("publisher_dispersed_farm")
        elif not (new_ip and new_session):
            w["long"].add(ts, "", long)
        short = {v for t, v in zip(w["ip"].times, ips) if t >= ts - c.ms("publisher_burst_s")}
        if len(burst) >= c.volume_min and len(burst) / len(short) >= c.volume_ratio:
            out.append("publisher_burst_volume")
        if e["prompt"] and len(set(w["prompt"].add(ts, e["prompt"], c.ms("prompt_s")))) >= c.prompt_min:
            out.append("publisher_prompt_replay")
        if e["country"] and len(set(w["country"].add(ts, e["country"], c.ms("geo_s")))) >= c.geo_min:
            out.append("publisher_geo_diversity")
        if e["prompt"] and len(set(w["slow"].add(ts, e["prompt"], c.ms("slow_prompt_s")))) >= c.slow_prompt_min:
            out.append("publisher_slow_prompt_replay")
        return out


def _keyed(rows: DataFrame, key: str, kind: type, cfg: RuleConfig, columns: str, out: str, ttl_ms: int | None) -> DataFrame:
    """Adds the reasons of a keyed state to its rows, in the order of seq within a batch of a key."""
    names = [c.split()[0] for c in columns.split(", ")]
    state_schema = ", ".join(f"t_{n} array<bigint>, v_{n} array<string>" for n in kind.PARTS)

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mine = kind(cfg, state.get if state.exists else None)
        pdf = pd.concat(list(frames)).sort_values("seq")
        found = [mine.reasons(e) for e in pdf.to_dict("records")]
        state.update(mine.save())
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pdf[names].assign(**{out: found})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(fold, f"{columns}, {out} array<string>", state_schema, "append", timeout)


#: What the keyed states need of an event, with texts trimmed and null as the empty text.
_EVENT = "seq bigint, ts bigint, session_id string, publisher_id string, user_ip string, user_agent string, country string, asn string, prompt string, whole string"


def session_stage(events: DataFrame, cfg: RuleConfig = RuleConfig(), ttl_ms: int | None = None) -> DataFrame:
    """The first stage: events (seq, ts, session_id, publisher_id, user_ip, user_agent, country, asn, prompt, language) with the session's reasons.

    Events are taken in the order of ``seq`` within what arrives together; those out of event-time order are
    seen as they come. Rows without session or time pass with no reasons. ``ttl_ms`` forgets a key that has
    been silent for so long (processing time); such a stream runs on and on, so it is for a continuous trigger
    and not for a run to the end.
    """
    word = lambda c: F.coalesce(strip(F.col(c).cast("string")), F.lit(""))
    x = events.select(
        "seq", "ts", word("session_id").alias("session_id"), word("publisher_id").alias("publisher_id"), word("user_ip").alias("user_ip"), word("user_agent").alias("user_agent"), F.upper(word("country")).alias("country"), word("asn").alias("asn"),
        F.lower(collapse_space(F.coalesce("prompt", F.lit("")))).alias("prompt"), F.to_json(F.struct("prompt", "language", "user_agent", "asn", "country")).alias("whole"),
    )
    usable = (F.col("session_id") != "") & F.col("ts").isNotNull()
    kept = _keyed(x.where(usable), "session_id", SessionState, cfg, _EVENT, "session_reasons", ttl_ms)
    return kept.unionByName(x.where(~usable).withColumn("session_reasons", F.array().cast("array<string>")))


def publisher_stage(rows: DataFrame, cfg: RuleConfig = RuleConfig(), ttl_ms: int | None = None) -> DataFrame:
    """The second stage: rows of the first with all rules, score, verdict and topic (seq, score, verdict, reasons, topic)."""
    raw = F.from_json("whole", "prompt string, language string, user_agent string, asn bigint, country string")
    own = strip(F.coalesce(raw["prompt"], F.lit("")))
    x = rows.withColumn("flagged", F.size("session_reasons") > 0).withColumn("bad_agent", bad_user_agent() | (F.col("user_agent") == "")).withColumn("prompt", F.when(own == "", "").otherwise(F.md5(own)))
    columns = _EVENT + ", session_reasons array<string>"
    usable = (F.col("publisher_id") != "") & F.col("ts").isNotNull()
    kept = _keyed(x.where(usable), "publisher_id", PublisherState, cfg, columns, "publisher_reasons", ttl_ms)
    names = [c.split()[0] for c in columns.split(", ")]
    out = kept.unionByName(x.where(~usable).select(*names).withColumn("publisher_reasons", F.array().cast("array<string>")))
    stateful = F.concat("session_reasons", "publisher_reasons")
    whole = out.select("seq", stateful.alias("stateful"), raw.alias("q")).select("seq", "stateful", "q.*")
    fired = {r: F.array_contains("stateful", r) for r in SESSION_RULES + PUBLISHER_RULES}
    judged = scored(with_stateless(whole).withColumns(fired), STATELESS + SESSION_RULES + PUBLISHER_RULES, cfg)
    return judged.select("seq", "score", "verdict", "reasons", topic(F.col("verdict")).alias("topic"))


def detect_stream(events: DataFrame, between: str, folder: str, checkpoint: str, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Both stages over all that is there now: session state, a table between (the keyed exchange is written, so a restart of
    either stage repeats nothing), publisher state, routed verdicts in ``folder``. Returns what is in the folder."""
    spark = events.sparkSession
    first = session_stage(events, cfg)
    run_to_table(first, between, f"{checkpoint}/session")
    second = publisher_stage(spark.readStream.schema(first.schema).parquet(between), cfg)
    run_to_table(second, folder, f"{checkpoint}/publisher")
    return spark.read.schema(second.schema).parquet(folder)


def hourly_corrections(events: DataFrame, grace_minutes: int = 5, cutoff_hours: int = 6) -> DataFrame:
    """Counts per key and hour as a stream: a row whenever a batch changes them (key, hour, n, n_late, n_dropped).

    Events need key, event_time and arrived_at (timestamps). Partial counts of a batch are made before the
    state, whose key is (key, hour), so a hot key costs its hours only.
    """
    hour_us = 3_600_000_000
    e, a = F.unix_micros("event_time"), F.unix_micros("arrived_at")
    hour = F.floor(e / hour_us)
    end = (hour + 1) * hour_us
    rows = events.where("key is not null and event_time is not null and arrived_at is not null").select(
        "key", hour.alias("hour"), F.when(a <= end + grace_minutes * 60_000_000, 0).when(a <= end + cutoff_hours * hour_us, 1).otherwise(2).alias("lateness")
    )

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, late, dropped = state.get if state.exists else (0, 0, 0)
        for pdf in frames:
            by = pdf["lateness"].value_counts()
            n, late, dropped = n + int(by.get(0, 0) + by.get(1, 0)), late + int(by.get(1, 0)), dropped + int(by.get(2, 0))
        state.update((n, late, dropped))
        yield pd.DataFrame([(*key, n, late, dropped)], columns=["key", "hour", "n", "n_late", "n_dropped"])

    return rows.groupBy("key", "hour").applyInPandasWithState(fold, "key string, hour bigint, n bigint, n_late bigint, n_dropped bigint", "n bigint, late bigint, dropped bigint", "update", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, key: str, event_time: str, horizon: str) -> DataFrame:
    """First delivery of each key; keys are forgotten once the watermark passes the horizon."""
    return events.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])


def run_to_table(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now into a parquet folder (append) and end."""
    df.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
