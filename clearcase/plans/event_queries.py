"""Queries over outcomes, product events and request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearcase.bindings import bound, cte
from clearcase.operators import events as ev
from clearcase.operators import outcomes as oc
from clearcase.plans.registry import query

_CHECKED = f"""
WITH {cte('outcomes')},
c AS (SELECT id, ts, trim(cpt_code) AS cpt_code, trim(payer_name) AS payer_name, outcome,
             CASE WHEN outcome = 'denied' THEN nullif(trim(denial_reason), '') END AS denial_reason, pa_score,
             CASE WHEN coalesce(cpt_code, '') = '' THEN 'cpt_code' WHEN coalesce(payer_name, '') = '' THEN 'payer_name'
                  WHEN outcome NOT IN ('approved', 'denied', 'pending') THEN 'outcome' WHEN pa_score IS NULL THEN 'pa_score'
                  WHEN length(denial_reason) > 5000 THEN 'denial_reason' END AS rejected FROM outcomes)
"""


def _checked(spark, sf):
    return oc.checked(bound(spark, sf, "outcomes"))


@query("outcome_validation", _CHECKED + "SELECT id, cpt_code, payer_name, outcome, denial_reason, pa_score, rejected FROM c")
def outcome_validation(spark, sf):
    return _checked(spark, sf).drop("ts")


@query("outcome_newest", _CHECKED + """
SELECT id, cpt_code, outcome, denial_reason IS NOT NULL AS has_reason FROM c WHERE rejected IS NULL ORDER BY ts DESC, id DESC LIMIT 10000""")
def outcome_newest(spark, sf):
    accepted = _checked(spark, sf).where("rejected IS NULL")
    return oc.newest(accepted).select("id", "cpt_code", "outcome", F.col("denial_reason").isNotNull().alias("has_reason"))


@query("outcome_denial_rates", _CHECKED + """
, b AS (SELECT *, CASE WHEN pa_score >= 8 THEN 'strong' WHEN pa_score >= 5 THEN 'moderate' ELSE 'high risk' END AS band FROM c WHERE rejected IS NULL)
SELECT payer_name, cpt_code, band, count(*) AS n, count(*) FILTER (outcome = 'denied') AS denied,
       count(*) FILTER (outcome = 'approved') AS approved, grouping_id(payer_name, cpt_code, band) AS level,
       round(count(*) FILTER (outcome = 'denied') / count(*), 6) AS denial_rate
FROM b GROUP BY CUBE (payer_name, cpt_code, band)""")
def outcome_denial_rates(spark, sf):
    return oc.denial_rates(_checked(spark, sf).where("rejected IS NULL"))


@query("request_limit_breaches", f"""
WITH {cte('requests')},
w AS (SELECT *, count(*) OVER (PARTITION BY class, key ORDER BY at_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS in_window FROM requests)
SELECT event_id, class, key, in_window,
       in_window > CASE class WHEN 'generation' THEN 8 WHEN 'regeneration' THEN 15 WHEN 'light' THEN 30 ELSE 10 END AS breach FROM w""")
def request_limit_breaches(spark, sf):
    return ev.trailing_requests(bound(spark, sf, "requests")).drop("at_ms")


@query("request_sliding_counts", f"""
WITH {cte('requests')}
SELECT CAST(floor(at_ms / 10000) * 10 - 10 * i AS BIGINT) AS window_start, class, key, count(*) AS n
FROM requests CROSS JOIN range(6) r(i) GROUP BY 1, 2, 3""")
def request_sliding_counts(spark, sf):
    requests = bound(spark, sf, "requests").withColumn("at", F.timestamp_millis("at_ms"))
    return ev.sliding_counts(requests).select(F.unix_seconds("w.start").alias("window_start"), "class", "key", "n")


@query("event_hourly_counts", f"""
WITH {cte('product_events')}
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event,
       CASE WHEN event = 'pa_generation_failed' THEN json_extract_string(props, '$.stage') ELSE '-' END AS stage, count(*) AS n
FROM product_events GROUP BY 1, 2, 3""")
def event_hourly_counts(spark, sf):
    hourly = ev.hourly_counts(bound(spark, sf, "product_events"))
    return hourly.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event", "stage", "n")


@query("generation_latency", f"""
WITH {cte('product_events')},
p AS (SELECT json_extract_string(props, '$.payer') AS payer, CAST(json_extract_string(props, '$.duration_ms') AS BIGINT) AS d,
             CAST(json_extract_string(props, '$.hard_block_count') AS BIGINT) AS h FROM product_events WHERE event = 'pa_generation_succeeded')
SELECT payer, count(*) AS n, round(avg(d), 3) AS avg_ms, round(quantile_cont(d, 0.5), 3) AS median_ms,
       round(avg(h), 6) AS avg_hard_blocks, count(*) FILTER (h > 0) AS blocked FROM p GROUP BY 1""")
def generation_latency(spark, sf):
    return ev.latency_by_payer(bound(spark, sf, "product_events"))


@query("user_funnel", f"""
WITH {cte('product_events')},
s AS (SELECT user_id, min(ts) AS a FROM product_events WHERE event = 'pa_generation_started' GROUP BY 1),
u AS (SELECT s.user_id, s.a, min(e.ts) AS b FROM s LEFT JOIN product_events e
      ON e.user_id = s.user_id AND e.event = 'pa_generation_succeeded' AND e.ts >= s.a GROUP BY 1, 2),
x AS (SELECT u.user_id, u.a, u.b, min(e.ts) AS c FROM u LEFT JOIN product_events e
      ON e.user_id = u.user_id AND e.event = 'pa_exported' AND e.ts >= u.b GROUP BY 1, 2, 3)
SELECT user_id, epoch_us(a) AS started_us, epoch_us(b) AS succeeded_us, epoch_us(c) AS exported_us FROM x""")
def user_funnel(spark, sf):
    steps = ev.funnel(bound(spark, sf, "product_events"))
    return steps.select("user_id", *[
        F.unix_micros(F.col(f"{c}_at").cast("timestamp")).alias(f"{c}_us") for c in ("started", "succeeded", "exported")])


@query("event_first_occurrences", f"""
WITH {cte('product_events')}
SELECT user_id, event, arg_min(event_id, (ts, event_id)) AS event_id FROM product_events GROUP BY 1, 2""")
def event_first_occurrences(spark, sf):
    return ev.first_occurrences(bound(spark, sf, "product_events"), "user_id", "event")


@query("metering_by_month", f"""
WITH {cte('pa_cases')}
SELECT org_id, surgeon_id, strftime(created_at, '%Y-%m') AS period, count(*) AS n FROM pa_cases GROUP BY 1, 2, 3""")
def metering_by_month(spark, sf):
    return bound(spark, sf, "pa_cases").groupBy(
        "org_id", "surgeon_id", F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))
