"""Event streams over ``events``: each user's events are the events of a request."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.sources.tables import table
from lodestrand.streaming import requests as R

QUERIES, SQL = {}, {}
#: Users come back after hours, so silence is longer here than the default.
_IDLE = 6 * 3600
_KIND = "case event_type " + " ".join(f"when '{t}' then {'null' if k is None else f"'{k}'"}" for t, _, k in R.TAXONOMY) + " end"
_STEP = "case event_type " + " ".join(f"when '{t}' then '{s}'" for t, s, _ in R.TAXONOMY) + " end"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    f"""with e as (select user_id::varchar as request, event_id, epoch_us(ts) // 1000 as ms, {_KIND} as kind from events where ts is not null), w as (select max(ms) - 600000 as mark from e),
b as (select *, coalesce(kind, 'null') in ('final', 'error', 'null') as ends, row_number() over p as rn, lag(ms) over p as before from e window p as (partition by request order by ms, event_id)),
s as (select *, sum(case when rn = 1 or ms - before > {_IDLE * 1000} or lag_ends then 1 else 0 end) over (partition by request order by ms, event_id) - 1 as session from (select *, lag(ends) over (partition by request order by ms, event_id) as lag_ends from b)),
g as (select request, session::int as session, min(ms) as started_ms, max(ms) as last, count(*)::int as n_events, string_agg(event_id::varchar, ' ' order by ms, event_id) as events, bool_or(ends) as ended, arg_max(coalesce(kind, 'null'), (ms, event_id)) as kind from s group by all)
select request, session, started_ms, case when ended then last else last + {_IDLE * 1000} end as ended_ms, n_events, events, case when ended then kind else 'timeout' end as outcome
from g, w where case when ended then last <= mark else last + {_IDLE * 1000} < mark end"""
)
def m3_request_sessions(spark, sf_dir):
    """M1 to M3: a stateful stream: events appended for each request until a final one, an error, a null or silence ends it."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    found = R.run_sessions(spark, events.select(F.col("user_id").alias("request"), F.col("event_id").alias("event"), "ts", F.expr(_KIND).alias("kind")), idle_seconds=_IDLE)
    return found.withColumn("events", F.array_join("events", " "))


@query(f"select {_STEP} as step, {_KIND} as kind, count(*) as n_events, count(distinct user_id) as n_requests from events group by all")
def m3_event_taxonomy(spark, sf_dir):
    """M3: steps and kinds of the events."""
    events = table(spark, sf_dir, "events").select("user_id", F.expr(_STEP).alias("step"), F.expr(_KIND).alias("kind"))
    return events.groupBy("step", "kind").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_requests"))
