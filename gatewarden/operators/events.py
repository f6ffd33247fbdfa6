"""Event records: tolerant parsing, envelopes and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden import config
from gatewarden.functions.text import strip


def parse_json(df: DataFrame, value: str) -> DataFrame:
    """Adds ``event`` (VARIANT) and ``parse_error``: invalid_json, invalid_event_type (not an object) or null.

    A null value is invalid JSON. No type is forced here, so one leaf of another type spoils nothing else.
    """
    parsed = F.try_parse_json(F.col(value))
    kind = F.schema_of_variant(F.col("event"))
    return df.withColumn("event", parsed).withColumn("parse_error", F.when(F.col("event").isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "invalid_event_type"))


def maybe_json(c: Column) -> Column:
    """VARIANT of a text that holds a JSON object or array; null for any other text."""
    return F.when(strip(c).rlike(r"^[\[{]"), F.try_parse_json(c))


def text_at(path: str, event: str = "event", default: str | None = "") -> Column:
    got = F.try_variant_get(F.col(event), path, "string")
    return F.coalesce(got, F.lit(default)) if default is not None else got


def asn_at(path: str, event: str = "event") -> Column:
    """Integer of a number or of a text of digits, cut toward zero; anything else is null."""
    text = F.trim(F.try_variant_get(F.col(event), path, "string"))
    is_text = F.try_variant_get(F.col(event), path, "double").isNull()
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    return F.coalesce(whole, F.when(~is_text & F.schema_of_variant(F.try_variant_get(F.col(event), path, "variant")).rlike("DECIMAL|DOUBLE|FLOAT"), F.try_variant_get(F.col(event), path, "double").cast("bigint")))


def reasons_at(path: str, event: str = "event") -> Column:
    """Array of texts; null gives an empty list, a single value a list of one."""
    listed = F.try_variant_get(F.col(event), path, "array<string>")
    one = F.try_variant_get(F.col(event), path, "string")
    return F.coalesce(listed, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def raw_request(event: str = "event") -> Column:
    """Struct of a raw request with the defaults of missing or mistyped parts."""
    t = lambda p: text_at(p, event)
    return F.struct(
        t("$.event_time").alias("event_time"), t("$.req_id").alias("req_id"), t("$.prompt").alias("prompt"), t("$.language").alias("language"),
        F.struct(t("$.request_context.session_id").alias("session_id"), t("$.request_context.user_agent").alias("user_agent"), t("$.request_context.user_ip").alias("user_ip")).alias("request_context"),
        F.struct(t("$.optional_context.country").alias("country"), asn_at("$.optional_context.asn", event).alias("asn")).alias("optional_context"),
        t("$.publisher_id").alias("publisher_id"),
    )


def fraud_context(verdict: Column, score: Column, reasons: Column, source: str = "flink") -> Column:
    return F.struct(F.lit(source).alias("source"), verdict.alias("verdict"), score.alias("score"), reasons.alias("reasons"))


def model_context(verdict: Column, score: Column, version: Column, threshold: Column) -> Column:
    return F.struct(F.lit("rfc_scoring").alias("source"), verdict.alias("verdict"), score.alias("score"), version.alias("model_version"), threshold.alias("threshold"), F.array().cast("array<string>").alias("reasons"))


def moderation_context(verdict: Column, method: Column, score: Column, reasons: Column, similarity: Column, threshold: float, version: str, called: Column | None = None, call_reason: Column | None = None, call_error: Column | None = None) -> Column:
    no = F.lit(False)
    return F.struct(
        F.lit("moderation").alias("source"), verdict.alias("verdict"), method.alias("method"), score.alias("score"), reasons.alias("reasons"), similarity.alias("similarity_score"), F.lit(threshold).alias("similarity_threshold"),
        F.lit(version).alias("reference_version"), (no if called is None else called).alias("openai_called"), (F.lit("") if call_reason is None else call_reason).alias("openai_reason"), (no if call_error is None else call_error).alias("openai_error"),
    )


BLOCK_SOURCES, BLOCK_VERDICTS = ("flink", "rfc_scoring", "moderation"), ("fraud", "unsafe")


def blocked(request: Column, source: Column, verdict: Column, score: Column, reasons: Column) -> Column:
    """Envelope of a blocked request; an unknown source or verdict raises when the row is read."""
    valid = source.isin(*BLOCK_SOURCES) & verdict.isin(*BLOCK_VERDICTS)
    checked = F.when(valid, source).otherwise(F.raise_error(F.concat(F.lit("no such source or verdict: "), source, F.lit(" "), verdict)).cast("string"))
    return F.struct(request["event_time"].alias("event_time"), request["req_id"].alias("req_id"), request["publisher_id"].alias("publisher_id"), checked.alias("source"), verdict.alias("verdict"), score.alias("score"), reasons.alias("reasons"), request.alias("request"))


def parse_error_envelope(value: Column, error: Column) -> Column:
    """Envelope of an unreadable message: fraud with score 1, holding the raw text."""
    return F.struct(F.lit("flink").alias("source"), F.lit("fraud").alias("verdict"), F.lit(1.0).alias("score"), F.array(error).alias("reasons"), F.struct(value.alias("raw")).alias("request"))


def topic(verdict: Column) -> Column:
    routes = F.create_map(*[F.lit(x) for kv in config.TOPICS.items() for x in kv])
    return F.try_element_at(routes, verdict)


def json_list(texts: Column) -> Column:
    """Texts as a JSON array with a space after each comma."""
    quoted = F.transform(texts, lambda t: F.concat(F.lit('"'), F.regexp_replace(t, r'(["\\\\])', r"\\\\$1"), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def log_line(verdict: Column, req_id: Column, score: Column, reasons: Column, to: Column) -> Column:
    return F.format_string(f"{config.LOG_PREFIX} %s req_id=%s score=%.3f reasons=%s -> %s", F.upper(verdict), req_id, score, json_list(reasons), to)


def is_suspicious(verdict: Column) -> Column:
    return F.coalesce(F.lower(strip(verdict)) == "suspicious", F.lit(False))


def publishable(req_id: Column, prompt: Column) -> Column:
    return (F.coalesce(req_id, F.lit("")) != "") & (F.coalesce(prompt, F.lit("")) != "")


def nested_or_own(own: Column, nested: Column) -> Column:
    """Identifier at the top, or else that of the nested request."""
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(nested, F.lit("")))


def turns(df: DataFrame, conversation: str, own: str | None = None, role: str = "user") -> DataFrame:
    """One row per turn of the role (a turn without role is the user's) with its place; blank prompts dropped.

    A row with a null or empty conversation is its own single turn, with the prompt in the column ``own``;
    a turn without content takes that prompt too. Without ``own`` such rows give no turns.
    """
    prompt = F.col(own) if own else F.lit(None).cast("string")
    x = df.select("*", F.posexplode_outer(F.col(conversation)).alias("turn", "__t")).withColumn("content", F.coalesce(F.nullif(F.col("__t.content"), F.lit("")), prompt))
    x = x.withColumn("turn", F.coalesce("turn", F.lit(0)))
    return x.where(F.coalesce(F.col("__t.role"), F.lit("user")) == role).where(strip(F.coalesce("content", F.lit(""))) != "").drop("__t")


def feature_event(topic: Column, event: str = "event") -> Column:
    """VARIANT of the event that features are read from: of a blocked message the request within, else the message."""
    inner = F.try_variant_get(F.col(event), "$.request", "variant")
    is_object = F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))
    return F.when((topic == config.TOPICS["fraud"]) & is_object, inner).otherwise(F.col(event))


def header_value(header: Column, *names: str) -> Column:
    """First of the named values of a header given as JSON text; null for any other text."""
    v = maybe_json(header)
    return F.coalesce(*[F.nullif(F.try_variant_get(v, f"$['{n}']", "string"), F.lit("")) for n in names])


def enriched(event: str = "event") -> Column:
    """Struct of an enriched request: the raw request with the contexts of the stages it has passed, with the defaults of missing or mistyped parts."""
    number = lambda path, default: F.coalesce(F.try_variant_get(F.col(event), path, "double"), F.lit(default))
    flag = lambda path: F.coalesce(F.try_variant_get(F.col(event), path, "boolean"), F.lit(False))
    word = lambda path, default: F.coalesce(F.nullif(text_at(path, event), F.lit("")), F.lit(default))
    fraud = F.struct(word("$.fraud.source", "flink").alias("source"), word("$.fraud.verdict", "clean").alias("verdict"), number("$.fraud.score", 0.0).alias("score"), reasons_at("$.fraud.reasons", event).alias("reasons"))
    model = F.struct(
        text_at("$.rfc.source", event).alias("source"), text_at("$.rfc.verdict", event).alias("verdict"), number("$.rfc.score", 0.0).alias("score"), text_at("$.rfc.model_version", event).alias("model_version"),
        number("$.rfc.threshold", 0.5).alias("threshold"), reasons_at("$.rfc.reasons", event).alias("reasons"),
    )
    judged = F.struct(
        word("$.moderation.verdict", "clean").alias("verdict"), word("$.moderation.method", "tfidf_gate").alias("method"), number("$.moderation.score", 0.0).alias("score"), reasons_at("$.moderation.reasons", event).alias("reasons"),
        number("$.moderation.similarity_score", 0.0).alias("similarity_score"), number("$.moderation.similarity_threshold", 0.30).alias("similarity_threshold"), text_at("$.moderation.reference_version", event).alias("reference_version"),
        flag("$.moderation.openai_called").alias("openai_called"), text_at("$.moderation.openai_reason", event).alias("openai_reason"), flag("$.moderation.openai_error").alias("openai_error"),
    )
    return F.struct(raw_request(event).alias("request"), fraud.alias("fraud"), model.alias("rfc"), judged.alias("moderation"))
