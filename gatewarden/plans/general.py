"""Queries p2 and p4 on raw_requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.functions.text import clean_id
from gatewarden.functions.times import iso_hour, iso_timestamp
from gatewarden.operators.dedup_index import build_index, exactly_once, superfluous
from gatewarden.operators.late_replay import hourly_counts
from gatewarden.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_requests")
    return superfluous(rows, build_index(rows, "req_id", "delivery_id"), "req_id", "delivery_id")


def p4_index_report(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers held per hash prefix."""
    rows = table(spark, folder, "raw_requests")
    index = build_index(rows, "req_id", "delivery_id")
    return index._index().groupBy("prefix").agg(F.sum(F.size("kept")).alias("n_ids"))


def _hours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_requests").select("delivery_id", "req_id", "event_time", "arrived_at", "publisher_id")
    index = build_index(rows, "req_id", "delivery_id")
    once = exactly_once(rows, index, "req_id", "delivery_id")
    counts = hourly_counts(once, clean_id(F.col("publisher_id")), iso_timestamp(F.col("event_time")), F.col("arrived_at"))
    return counts.withColumnRenamed("key", "publisher_id").withColumn("hour_start", iso_hour(F.col("hour"))).drop("hour")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _hours(spark, folder).where("n_late > 0").select("publisher_id", "hour_start")


def p2_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return _hours(spark, folder).select("publisher_id", "hour_start", "first_count", "final_count", "day_count", "n_late", "n_dropped")


#: The reading of event times in DuckDB; timestamps there are UTC without zone.
_PARSED = r"""
ids as (select *, nullif(regexp_replace(lower(req_id), '^\s+|\s+$', '', 'g'), '') as rid,
               nullif(regexp_replace(lower(publisher_id), '^\s+|\s+$', '', 'g'), '') as pub from raw_requests),
once as (select * from ids where rid is null
         union all select * from ids where rid is not null qualify row_number() over (partition by rid order by delivery_id) = 1),
timed as (select *, case when regexp_matches(trim(event_time), '^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?$')
                    then try_cast(replace(trim(event_time), ' ', 'T')
                         || case when regexp_matches(trim(event_time), '(Z|[+-]\d\d:?\d\d)$') then '' else 'Z' end as timestamptz) at time zone 'UTC' end as e from once),
hours as (select pub as publisher_id, date_trunc('hour', e) as h, arrived_at as a,
                 case when arrived_at <= date_trunc('hour', e) + interval 65 minute then 0
                      when arrived_at <= date_trunc('hour', e) + interval 7 hour then 1 else 2 end as lateness
          from timed where e is not null and pub is not null and arrived_at is not null)
"""

QUERIES = {"p2_found": p2_found, "p2_hourly": p2_hourly, "p4_found": p4_found, "p4_index_report": p4_index_report}

ORACLE = {
    "p2_found": f"with {_PARSED} select publisher_id, strftime(h, '%Y-%m-%dT%H:%M:%SZ') as hour_start from hours group by publisher_id, h having count_if(lateness = 1) > 0",
    "p2_hourly": f"""with {_PARSED}, g as (select publisher_id, h, cast(count_if(lateness = 0) as bigint) as first_count, cast(count_if(lateness < 2) as bigint) as final_count,
        cast(count_if(lateness = 1) as bigint) as n_late, cast(count_if(lateness = 2) as bigint) as n_dropped from hours group by 1, 2)
        select publisher_id, strftime(h, '%Y-%m-%dT%H:%M:%SZ') as hour_start, first_count, final_count,
               case when final_count = 0 then 0 else cast(sum(final_count) over (partition by publisher_id, date_trunc('day', h) order by h) as bigint) end as day_count,
               n_late, n_dropped from g""",
    "p4_found": r"""select delivery_id from raw_requests where nullif(regexp_replace(lower(req_id), '^\s+|\s+$', '', 'g'), '') is not null
        qualify row_number() over (partition by regexp_replace(lower(req_id), '^\s+|\s+$', '', 'g') order by delivery_id) > 1""",
    "p4_index_report": r"""with d as (select distinct md5(regexp_replace(lower(req_id), '^\s+|\s+$', '', 'g')) as m from raw_requests
        where nullif(regexp_replace(lower(req_id), '^\s+|\s+$', '', 'g'), '') is not null)
        select cast(('0x' || substr(m, 1, 6))::bigint % 64 as integer) as prefix, cast(count(*) as bigint) as n_ids from d group by 1""",
}
