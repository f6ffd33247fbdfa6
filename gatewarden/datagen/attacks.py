"""Synthetic identities and the attack families.

Every random choice is a hash of the seed and of what is chosen for, so a row needs no other row: families
are arithmetic on row numbers, and can be made by any number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewarden import config
from gatewarden.functions.text import hex_number, hex_prefix
from gatewarden.functions.times import iso_text, iso_timestamp

EVENT = (
    "struct<event_time: string, req_id: string, prompt: string, language: string, request_context: struct<session_id: string, user_agent: string, user_ip: string>, "
    "optional_context: struct<country: string, asn: bigint>, publisher_id: string>"
)


def synthetic_ip(identity: Column, country: Column) -> Column:
    d = F.sha2(F.concat(country, F.lit(":"), identity), 256)
    first = F.get(F.array(*map(F.lit, config.FIRST_OCTETS)), hex_number(d, 0) % len(config.FIRST_OCTETS))
    return F.concat_ws(".", first, hex_number(d, 1), hex_number(d, 2), F.greatest(hex_number(d, 3), F.lit(1)))


def synthetic_asn(identity: Column, country: Column, separator: str = "|") -> Column:
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in config.ASN_BASE.items() for x in kv]), F.upper(country)), F.lit(90_000))
    digest = hex_prefix(6, identity, country) if separator == "|" else F.substring(F.sha2(F.concat(identity, F.lit(separator), country), 256), 1, 6)
    return base + F.conv(digest, 16, 10).cast("int") % 900


def draw(*seed: Column) -> Column:
    """A number of [0, 1) from the hash of the seed."""
    return F.conv(hex_prefix(8, *seed), 16, 10).cast("double") / float(16**8)


def between(least: float, most: float, *seed: Column) -> Column:
    """A whole number of the range, or the bound itself if there is one only."""
    return F.lit(float(least)) if least == most else (F.floor(draw(*seed) * (most - least + 1)) + least).cast("double")


def pick(values: list[str], *seed: Column) -> Column:
    """One of the values by the hash of the seed."""
    return F.get(F.array(*map(F.lit, values)), (F.conv(hex_prefix(6, *seed), 16, 10).cast("bigint") % len(values)).cast("int"))


def weighted_pick(values: list[str], weights: list[float], *seed: Column) -> Column:
    """One of the values by weight: the hash of the seed against the running weights."""
    total, at, out = sum(weights), 0.0, F.lit(values[-1])
    place = draw(*seed)
    bounds = []
    for v, x in zip(values[:-1], weights[:-1]):
        at += x / total
        bounds.append((v, at))
    for v, b in reversed(bounds):
        out = F.when(place < b, v).otherwise(out)
    return out


#: An event that attacks are modelled on if no rows are given.
DEFAULT_SOURCE = {"event_time": "2024-03-01T00:00:00+00:00", "req_id": "source", "prompt": "tell me about the offer", "language": "English", "user_agent": config.USER_AGENTS[0], "country": "US"}


def source_event(clean: DataFrame, name: str, seed: int = 1337) -> dict:
    """The event that a family is modelled on: of an abusive publisher's rows (or of all) the first by the hash of seed, family and req_id."""
    abusive = [p for p, kind in config.PUBLISHERS.items() if kind in ("fully_abusive", "mildly_abusive")]
    order = F.struct((~F.coalesce(F.col("event.publisher_id").isin(abusive), F.lit(False))).alias("other"), F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(name), F.col("event.req_id")), 256).alias("h"), F.col("event.event_time").alias("t"))
    row = clean.where("event.req_id is not null").agg(F.min_by("event", order).alias("e")).first()
    if row is None or row.e is None:
        return DEFAULT_SOURCE
    e = row.e
    return {"event_time": e.event_time, "req_id": e.req_id, "prompt": e.prompt, "language": e.language or "unknown", "user_agent": e.request_context.user_agent, "country": e.optional_context.country or "US"}


def family(spark: SparkSession, name: str, clean: DataFrame | None = None, seed: int = 1337) -> DataFrame:
    """Labelled rows of one attack family: event, is_fraud, attack_type, attack_id, injected, source_req_id, publisher_profile.

    With ``clean`` (rows with an event) the family copies the prompt, language, user agent, country and start
    of one of them; an empty table, or none, takes a default event.
    """
    sessions, (fewest, most), apart, gap = config.ATTACKS[name]
    src = source_event(clean, name, seed) if clean is not None else DEFAULT_SOURCE
    attack_id = f"{name}_001"
    abusive = [p for p, kind in config.PUBLISHERS.items() if kind in ("fully_abusive", "mildly_abusive")]
    publisher = pick(abusive, F.lit(str(seed)), F.lit(name))
    profile = F.element_at(F.create_map(*[F.lit(x) for kv in config.PUBLISHERS.items() for x in kv]), publisher)
    base = spark.range(sessions * most).select((F.floor(F.col("id") / most)).alias("s"), (F.col("id") % most).alias("k"), "id")
    s, k = F.col("s").cast("string"), F.col("k").cast("string")
    key = (F.lit(str(seed)), F.lit(name), s, k)
    if fewest < most:
        base = base.where(F.col("k") < between(fewest, most, F.lit(str(seed)), F.lit(name), s, F.lit("rows")))
    session = F.substring(F.sha2(F.concat(F.lit(attack_id + ":"), s), 256), 1, 32)
    if name == "slow_distributed_abuse":  # anywhere in the six hours
        start = between(apart[0] / 60, apart[1] / 60, F.lit(str(seed)), F.lit(name), s, F.lit("start")) * 60
    else:
        start = F.col("s") * between(*apart, F.lit(str(seed)), F.lit(name), s, F.lit("start"))
    seconds = start + F.col("k") * between(*gap, *key, F.lit("gap"))
    micros = F.unix_micros(iso_timestamp(F.lit(src["event_time"]))) + F.round(seconds * 1_000_000).cast("bigint")
    pair = pick([f"{a}|{b}" for a, b in config.MISMATCHES], *key, F.lit("pair"))
    country = F.split_part(pair, F.lit("|"), F.lit(2)) if name == "geo_mismatch" else F.lit(src["country"])
    language = F.split_part(pair, F.lit("|"), F.lit(1)) if name == "geo_mismatch" else F.lit(src["language"])
    agent = F.get(F.array(*map(F.lit, config.ROTATING_AGENTS)), (F.col("id") % len(config.ROTATING_AGENTS)).cast("int")) if name == "ua_rotation" else F.lit(src["user_agent"])
    event = F.struct(
        F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("event_time"),
        F.format_string(f"{name}_%04d_%d", F.col("s").cast("int"), F.col("k").cast("int")).alias("req_id"),
        F.lit(src["prompt"]).alias("prompt"), language.alias("language"),
        F.struct(session.alias("session_id"), agent.alias("user_agent"), synthetic_ip(session, country).alias("user_ip")).alias("request_context"),
        F.struct(country.alias("country"), synthetic_asn(session, country, ":").cast("bigint").alias("asn")).alias("optional_context"), publisher.alias("publisher_id"),
    )
    return base.select(
        event.cast(EVENT).alias("event"), F.lit(1).alias("is_fraud"), F.lit(name).alias("attack_type"), F.lit(attack_id).alias("attack_id"), F.lit(True).alias("injected"), F.lit(src["req_id"]).alias("source_req_id"), profile.alias("publisher_profile")
    )


#: Registry of injectors: name to a function that gives the family's rows.
INJECTORS: dict[str, Callable[..., DataFrame]] = {name: (lambda spark, name=name, **kw: family(spark, name, **kw)) for name in config.ATTACKS}


def with_attacks(clean: DataFrame, *names: str, seed: int = 1337) -> DataFrame:
    """Clean labelled rows and those of the attack families modelled on them."""
    out = clean
    for name in names or INJECTORS:
        out = out.unionByName(INJECTORS[name](clean.sparkSession, clean=clean, seed=seed), allowMissingColumns=True)
    return out


def publisher_weights(seed: int = 1337) -> dict[str, float]:
    """Weight of each publisher: drawn from 0.5 to 4, the fully abusive one a hundredth of it, clean ones 1.3 times."""
    import hashlib

    out = {}
    for p, kind in config.PUBLISHERS.items():
        w = 0.5 + 3.5 * int(hashlib.sha256(f"{seed}|{p}".encode()).hexdigest()[:8], 16) / 16**8
        out[p] = round(w * (0.01 if kind == "fully_abusive" else 1.3 if kind == "clean" else 1.0), 6)
    return out


def sticky_publisher(session: Column, seed: int = 1337) -> Column:
    """Publisher of a session: a weighted choice by the hash of the session, so that a session has one wherever its rows are."""
    weights = publisher_weights(seed)
    return weighted_pick(list(weights), list(weights.values()), F.lit(str(seed)), session)


def profile_of(publisher: Column) -> Column:
    """Profile of a publisher; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in config.PUBLISHERS.items() for x in kv]), publisher)


def clean_rows(turns: DataFrame, seed: int = 1337, limit: int | None = None) -> DataFrame:
    """Labelled clean rows from user turns.

    ``turns`` has conversation_id, hashed_ip, turn, content, country, language, user_agent and timestamp (texts; any
    may be null). Missing identities fall back to the conversation, a missing country to US, a missing language to
    unknown, a missing agent to one of the default ones, and an unreadable time to the start of 2023. ``limit``
    keeps the first rows by req_id.
    """
    or_default = lambda c, d: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), d)
    conversation = F.col("conversation_id")
    ip, country = or_default("hashed_ip", conversation), F.upper(or_default("country", F.lit("US")))
    req_id = hex_prefix(32, conversation, F.col("turn").cast("string"), F.col("content"))
    agent = or_default("user_agent", pick(list(config.USER_AGENTS), F.lit(str(seed)), conversation, F.col("turn").cast("string")))
    publisher = sticky_publisher(conversation, seed)
    event = F.struct(
        iso_text(F.col("timestamp")).alias("event_time"), req_id.alias("req_id"), F.col("content").alias("prompt"), or_default("language", F.lit("unknown")).alias("language"),
        F.struct(conversation.alias("session_id"), agent.alias("user_agent"), synthetic_ip(ip, country).alias("user_ip")).alias("request_context"),
        F.struct(country.alias("country"), synthetic_asn(ip, country).cast("bigint").alias("asn")).alias("optional_context"), publisher.alias("publisher_id"),
    )
    rows = turns.where("conversation_id is not null and trim(coalesce(content, '')) <> ''").select(
        event.cast(EVENT).alias("event"), F.lit(0).alias("is_fraud"), F.lit("none").alias("attack_type"), F.lit(None).cast("string").alias("attack_id"), F.lit(False).alias("injected"), F.lit(None).cast("string").alias("source_req_id"), profile_of(publisher).alias("publisher_profile")
    )
    return rows if limit is None else rows.orderBy("event.req_id").limit(limit)


def session_splits(df: DataFrame, session: str, shares=(("train", 0.70), ("validation", 0.15), ("test", 0.15)), seed: str = "1337") -> DataFrame:
    """Adds ``split``: whole sessions, in the order of the hash of session and seed, fill the splits one after the other.

    A session goes to the first split whose target (its share of all rows and those of the splits before it) is
    not passed with it; the last takes the rest. The running count is of hash buckets first and of the sessions
    within a bucket then, so no task holds all sessions. Rows without a session go to the last split.
    """
    sizes = df.where(F.col(session).isNotNull()).groupBy(F.col(session).alias("__session")).agg(F.count("*").alias("__n")).withColumn("__h", F.sha2(F.concat_ws("|", "__session", F.lit(seed)), 256)).withColumn("__b", F.substring("__h", 1, 3))
    buckets = sizes.groupBy(F.col("__b").alias("__b2")).agg(F.sum("__n").alias("__m"))
    order = Window.orderBy("__b2")  # 4,096 buckets at most
    placed = buckets.select("__b2", F.coalesce(F.sum("__m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__m").over(Window.partitionBy(F.lit(1))).alias("__all"))
    within = sizes.withColumn("__run", F.sum("__n").over(Window.partitionBy("__b").orderBy("__h", "__session").rowsBetween(Window.unboundedPreceding, 0)))
    running = within.join(placed, F.col("__b") == F.col("__b2")).withColumn("__end", F.col("__run") + F.col("__before"))
    split, target = F.lit(shares[-1][0]), F.lit(0)
    bounds = []
    for name, share in shares[:-1]:
        target = target + F.floor(F.col("__all") * F.lit(share))
        bounds.append((name, target))
    for name, bound in reversed(bounds):
        split = F.when(F.col("__end") <= bound, name).otherwise(split)
    return df.join(running.select("__session", split.alias("split")), F.col(session) == F.col("__session"), "left").drop("__session").withColumn("split", F.coalesce("split", F.lit(shares[-1][0])))
