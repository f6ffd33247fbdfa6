"""Rules on single rows, on sessions, on publishers and on addresses, and their combination."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden import config
from gatewarden.config import RuleConfig
from gatewarden.functions import bitwise, cycles
from gatewarden.functions.text import collapse_space, strip
from gatewarden.operators import windows as w

STATELESS = ("negative_prompt", "bad_user_agent", "asn_risk", "geo_language_mismatch")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def negative_prompt(pattern: str = config.NEGATIVE_PROMPT) -> Column:
    return _text("prompt").rlike(f"(?i){pattern}")


def bad_user_agent() -> Column:
    return strip(_text("user_agent")).rlike(f"(?i){config.BAD_USER_AGENT}")


def asn_risk(asns=config.RISKY_ASNS) -> Column:
    return F.coalesce(F.col("asn").isin(*asns), F.lit(False))


def canonical_language(c: Column) -> Column:
    name = F.lower(strip(c))
    aliases = F.create_map(*[F.lit(x) for kv in config.LANGUAGE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, name), name)


def geo_language_mismatch() -> Column:
    """A language with known countries, used in a country known for other languages only."""
    language, country = canonical_language(F.col("language")), F.upper(strip(_text("country")))
    expected = F.create_map(*[x for k, v in config.LANGUAGE_COUNTRIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    known = sorted({c for v in config.LANGUAGE_COUNTRIES.values() for c in v})
    there = F.try_element_at(expected, language)
    return F.coalesce(there.isNotNull() & (language != "english") & country.isin(*known) & ~F.array_contains(there, country), F.lit(False))


def with_stateless(df: DataFrame, pattern: str = config.NEGATIVE_PROMPT, asns=config.RISKY_ASNS) -> DataFrame:
    return df.withColumns({"negative_prompt": negative_prompt(pattern), "bad_user_agent": bad_user_agent(), "asn_risk": asn_risk(asns), "geo_language_mismatch": geo_language_mismatch()})


def _value(c: str) -> Column:
    return F.nullif(strip(F.col(c).cast("string")), F.lit(""))


def session_signals(df: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Adds the session rules to rows (seq, ts, session_id, user_ip, user_agent, country, asn, prompt).

    One exchange by (session, block). Rows without time or session get false for all rules.
    """
    halo = max(cfg.ms(n) for n in ("session_burst_s", "churn_s", "cadence_s"))
    x = df.withColumns({"__ip": _value("user_ip"), "__co": F.upper(_value("country")), "__as": F.col("asn").cast("string"), "__ua": _value("user_agent")})
    b = w.blocked(x, "session_id", halo)
    b = b.withColumn("regular_cadence", w.regular_cadence("session_id", cfg.ms("cadence_s"), cfg.cadence_drift_ms))
    churn = cfg.ms("churn_s")
    b = w.with_windows(b, "session_id", {"n_session": (F.lit(1), cfg.ms("session_burst_s"))}, {"n_ip": ("__ip", churn), "n_country": ("__co", churn), "n_asn": ("__as", churn), "n_ua": ("__ua", churn)})
    b = w.unblocked(b).withColumns({
        "session_burst": F.col("n_session") > cfg.session_burst_max,
        "session_ip_churn": F.col("__ip").isNotNull() & (F.col("n_ip") >= cfg.churn_min),
        "session_country_hop": F.col("__co").isNotNull() & (F.col("n_country") > cfg.country_max),
        "session_asn_churn": F.col("__as").isNotNull() & (F.col("n_asn") >= cfg.churn_min),
        "session_ua_churn": F.col("__ua").isNotNull() & (F.col("n_ua") >= cfg.churn_min),
    })
    rest = x.where("session_id is null or ts is null")
    return b.unionByName(rest, allowMissingColumns=True).drop("__ip", "__co", "__as", "__ua")


def similar(prompt: str, earlier: list[str], ratio: float) -> bool:
    """Whether the prompt equals an earlier one or its matching blocks reach the ratio.

    The lengths, and then the longest common subsequence (matching blocks are one), bound the ratio from
    above, so most pairs are settled without the comparison.
    """
    if prompt in earlier:
        return True
    n, at = len(prompt), None
    for other in earlier:
        least = ratio * (n + len(other)) / 2
        if min(n, len(other)) < least:
            continue
        at = at or bitwise.masks(prompt)
        if bitwise.masked_lcs(at, n, other) >= least and difflib.SequenceMatcher(None, prompt, other).ratio() >= ratio:
            return True
    return False


def prompt_replays(df: DataFrame, cfg: RuleConfig = RuleConfig(), exact: bool = False) -> DataFrame:
    """``seq`` of the rows whose prompt repeats, the same or nearly, an earlier one of the session's window.

    Only session, time and prompt travel. ``exact`` compares in the JVM and finds equal prompts only. Blank
    prompts, and rows without session or time, are never replays.
    """
    window = cfg.ms("replay_s")
    x = df.select("seq", "ts", "session_id", F.nullif(F.lower(collapse_space(F.col("prompt"))), F.lit("")).alias("__p")).where("__p is not null")
    if exact:
        b = w.blocked(x.withColumn("__p", F.md5("__p")), "session_id", window)
        return w.unblocked(b.withColumn("__new", w.first_seen("session_id", "__p", window))).where("not __new").select("seq")
    b = w.blocked(x, "session_id", window).sortWithinPartitions("session_id", w.BLOCK, "ts", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, past = None, []
        for pdf in frames:
            found = []
            for s, block, ts, seq, p, halo in zip(pdf["session_id"], pdf[w.BLOCK], pdf["ts"], pdf["seq"], pdf["__p"], pdf[w.HALO]):
                if key != (s, block):
                    key, past = (s, block), []
                if past and past[0][0] < ts - window:
                    past = [(t, q) for t, q in past if t >= ts - window]
                if past and not halo and similar(p, [q for _, q in past], cfg.replay_ratio):
                    found.append(seq)
                past.append((ts, p))
            yield pd.DataFrame({"seq": pd.Series(found, dtype="int64")})

    return b.select("session_id", w.BLOCK, "ts", "seq", "__p", w.HALO).mapInPandas(run, "seq bigint")


def with_prompt_replay(df: DataFrame, cfg: RuleConfig = RuleConfig(), exact: bool = False) -> DataFrame:
    """Adds ``prompt_replay`` to the rows (see ``prompt_replays``)."""
    found = prompt_replays(df, cfg, exact).select(F.col("seq").alias("__seq"))
    return df.join(found, F.col("seq") == F.col("__seq"), "left").withColumn("prompt_replay", F.col("__seq").isNotNull()).drop("__seq")


def publisher_signals(df: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Adds the publisher rules; needs ``session_flagged`` (any session rule fired). One exchange by (publisher, block).

    Blank addresses and sessions count as values here. With ``compat`` the replay rules count distinct
    prompts, and user-agent rotation never fires, as coded; without, repetitions of the same prompt count.
    """
    halo = max(cfg.ms(n) for n in ("publisher_burst_s", "rate_s", "dispersion_s", "prompt_s", "slow_prompt_s", "geo_s"))
    x = df.withColumns({
        "__ip": strip(_text("user_ip")), "__se": _text("session_id"), "__pr": F.md5(_value("prompt")), "__co": F.upper(_value("country")),
        "__bad": (bad_user_agent() | (strip(_text("user_agent")) == "")).cast("int"), "__flag": F.coalesce(F.col("session_flagged"), F.lit(False)).cast("int"),
    })
    key = "publisher_id"
    b = w.blocked(x, key, halo)
    b = b.withColumns({"publisher_new_ip": w.first_seen(key, "__ip", cfg.ms("dispersion_s")), "publisher_new_session": w.first_seen(key, "__se", cfg.ms("dispersion_s"))})
    burst, rate, long = cfg.ms("publisher_burst_s"), cfg.ms("rate_s"), cfg.ms("dispersion_s")
    b = w.with_windows(
        b, key,
        {"n_burst": (F.lit(1), burst), "n_rate": (F.lit(1), rate), "n_long": (F.lit(1), long), "n_flag": (F.col("__flag"), rate), "n_bad": (F.col("__bad"), rate)},
        {"n_ip_long": ("__ip", long), "n_ip_short": ("__ip", burst), "n_prompt": ("__pr", cfg.ms("prompt_s")), "n_prompt_slow": ("__pr", cfg.ms("slow_prompt_s")), "n_geo": ("__co", cfg.ms("geo_s"))},
    )
    enough = F.col("n_rate") >= cfg.rate_min
    b = w.unblocked(b).withColumns({
        "publisher_burst": F.col("n_burst") > cfg.publisher_burst_max,
        "publisher_suspicious_rate": enough & (F.col("n_flag") / F.col("n_rate") > cfg.rate_share),
        "publisher_bad_ua_rate": enough & (F.col("n_bad") / F.col("n_rate") > cfg.rate_share),
        "publisher_dispersed_farm": F.col("publisher_new_ip") & F.col("publisher_new_session") & (F.col("n_ip_long") / F.col("n_long") > cfg.farm_ratio),
        "publisher_burst_volume": (F.col("n_burst") >= cfg.volume_min) & (F.col("n_burst") / F.col("n_ip_short") >= cfg.volume_ratio),
        "publisher_prompt_replay": F.col("__pr").isNotNull() & (F.col("n_prompt") >= cfg.prompt_min),
        "publisher_geo_diversity": F.col("__co").isNotNull() & (F.col("n_geo") >= cfg.geo_min),
        "publisher_ua_rotation": F.lit(False),
        "publisher_slow_prompt_replay": F.col("__pr").isNotNull() & (F.col("n_prompt_slow") >= cfg.slow_prompt_min),
    })
    rest = x.where("publisher_id is null or ts is null")
    return b.unionByName(rest, allowMissingColumns=True).drop("__ip", "__se", "__pr", "__co", "__bad", "__flag")


def ua_rotations(df: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """``seq`` of the rows at which the window's user agents of the publisher repeat a cycle: rotation as documented.

    Only publisher, time and user agent travel. A task holds the codes of one (publisher, block) at a time, or of
    several small ones, and settles all its windows together.
    """
    window = cfg.ms("rotation_s")
    x = df.select("seq", "ts", "publisher_id", _value("user_agent").alias("__ua")).where("__ua is not null")
    b = w.blocked(x, "publisher_id", window).sortWithinPartitions("publisher_id", w.BLOCK, "ts", F.asc_nulls_last("seq"), "__ua")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in w.whole_keys(batches, ("publisher_id", w.BLOCK)):
            ts, seq, agent = w.codes(t, "ts"), t["seq"].fill_null(np.iinfo(np.int64).max).to_numpy(), w.codes(t, "__ua")
            other = w.key_changes(t, ("publisher_id", w.BLOCK))
            # gaps longer than the window are cut to just that, so one axis holds all keys
            at = np.cumsum(np.append(0, np.where(other, window + 1, np.minimum(np.diff(ts), window + 1))))
            hit = cycles.cyclic(agent, np.searchsorted(at, at - window), cfg.rotation_min_uas, cfg.rotation_min_requests)
            ends = np.flatnonzero(np.append(other | (np.diff(ts) != 0) | (np.diff(seq) != 0), True))  # rows alike in time and seq see one another
            hit = np.repeat(hit[ends], np.diff(ends, prepend=-1)) & ~w.codes(t, w.HALO)
            yield from t.select(["seq"]).filter(pa.array(hit)).to_batches()

    return b.select("publisher_id", w.BLOCK, "ts", "seq", "__ua", w.HALO).mapInArrow(run, "seq bigint")


def _with_flag(df: DataFrame, found: DataFrame, name: str) -> DataFrame:
    found = found.select(F.col("seq").alias("__seq"))
    return df.join(found, F.col("seq") == F.col("__seq"), "left").withColumn(name, F.col("__seq").isNotNull()).drop("__seq")


def with_ua_rotation(df: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Adds ``publisher_ua_rotation`` to the rows (see ``ua_rotations``); ``seq`` is unique."""
    return _with_flag(df, ua_rotations(df, cfg), "publisher_ua_rotation")


def ip_burst(df: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Adds ``n_ip_requests`` and ``ip_burst`` to rows with an address; a rule of its own, outside the score."""
    x = df.withColumn("__ip", _value("user_ip"))
    b = w.with_windows(w.blocked(x, "__ip", cfg.ms("ip_burst_s")), "__ip", {"n_ip_requests": (F.lit(1), cfg.ms("ip_burst_s"))}, {})
    return w.unblocked(b).withColumn("ip_burst", F.col("n_ip_requests") > cfg.ip_burst_max).drop("__ip")


def scored(df: DataFrame, rules: tuple[str, ...], cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Adds reasons (in rule order), score and verdict. Scores are added in hundredths, so 0.25 + 0.45 is 0.70."""
    fired = {r: F.coalesce(F.col(r), F.lit(False)) for r in rules}
    points = sum((F.when(c, cfg.scores[r]).otherwise(0) for r, c in fired.items()), F.lit(0))
    clipped = F.least(F.greatest(points, F.lit(0)), F.lit(100))
    return df.withColumns({
        "reasons": F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in fired.items()])),
        "score": clipped / F.lit(100.0),
        "verdict": F.when(clipped >= cfg.fraud, "fraud").when(clipped >= cfg.suspicious, "suspicious").otherwise("clean"),
    })


SESSION_RULES = ("session_burst", "regular_cadence", "session_ip_churn", "session_country_hop", "session_asn_churn", "session_ua_churn", "prompt_replay")
PUBLISHER_RULES = (
    "publisher_burst", "publisher_suspicious_rate", "publisher_bad_ua_rate", "publisher_new_ip", "publisher_new_session", "publisher_dispersed_farm",
    "publisher_burst_volume", "publisher_prompt_replay", "publisher_geo_diversity", "publisher_ua_rotation", "publisher_slow_prompt_replay",
)


#: Columns that the look-back rules need; the prompt goes as a digest.
_NARROW = ("seq", "ts", "session_id", "publisher_id", "user_ip", "user_agent", "country", "asn")


def detect(df: DataFrame, cfg: RuleConfig = RuleConfig(), exact_replay: bool = False) -> DataFrame:
    """All 22 rules: session windows, then publisher windows (they use the session's), then the rest, score and verdict.

    ``seq`` is unique. The windows are made on the narrow columns; their flags join the whole rows once, by seq.
    """
    narrow = df.select(*_NARROW, F.md5(_value("prompt")).alias("prompt"))
    replayed = prompt_replays(df, cfg, exact_replay).select(F.col("seq").alias("__seq"))
    x = session_signals(narrow, cfg).join(replayed, F.col("seq") == F.col("__seq"), "left").withColumn("prompt_replay", F.col("__seq").isNotNull()).drop("__seq")
    any_session = [F.coalesce(F.col(r), F.lit(False)) for r in SESSION_RULES]
    flagged = any_session[0]
    for c in any_session[1:]:
        flagged = flagged | c
    x = publisher_signals(x.withColumn("session_flagged", flagged), cfg)
    if not cfg.compat:
        x = _with_flag(x.drop("publisher_ua_rotation"), ua_rotations(df, cfg), "publisher_ua_rotation")
    added = [c for c in x.columns if c not in (*_NARROW, "prompt")]
    joined = df.join(x.select(F.col("seq").alias("__seq"), *added), F.col("seq") == F.col("__seq")).drop("__seq")
    return scored(with_stateless(joined), STATELESS + SESSION_RULES + PUBLISHER_RULES, cfg)
