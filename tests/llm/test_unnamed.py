"""Prompts without a req_id are scored and redacted, and are no cases."""

from pyspark.sql import functions as F

from gatewarden.llm import abuse, pii, queries
from gatewarden.llm.records import records

FOLDER = "/root/testdata/sf0.01"


def test_rows_without_req_id_come_out(spark, monkeypatch):
    monkeypatch.setattr(abuse, "fit_on", lambda *a, **k: abuse.AbuseNet())
    monkeypatch.setattr(pii, "fit_on", lambda *a, **k: pii.SpanField())
    raw = spark.read.parquet(f"{FOLDER}/raw_requests.parquet").where("prompt is not null")
    texts = raw.count() + spark.read.parquet(f"{FOLDER}/documents.parquet").where("text is not null").count()
    blank = raw.where(F.trim(F.coalesce("req_id", F.lit(""))) == "").count()
    assert blank > 0 and records(spark, FOLDER).where("record_id like 'delivery:%'").count() == 0
    for q in ("p1_scores", "p5_redacted"):
        out = queries.QUERIES[q](spark, FOLDER)
        assert out.count() == texts and out.where("record_id like 'delivery:%'").count() >= blank
    assert queries.QUERIES["p1_found"](spark, FOLDER).where("record_id like 'delivery:%'").count() == 0
