"""Queries over usage, billing, access and waitlist tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearcase.bindings import bound, cte
from clearcase.operators import access, usage
from clearcase.plans.registry import query

MONTH = ("1998-03-01", "1998-04-01")

_BILL = f"""
WITH {cte('organizations', 'surgeons', 'pa_cases')},
c AS (SELECT surgeon_id, count(*) AS n FROM pa_cases
      WHERE created_at >= TIMESTAMP '{MONTH[0]}' AND created_at < TIMESTAMP '{MONTH[1]}' GROUP BY 1),
b AS (SELECT o.id AS org_id, o.last_acknowledged_surgeon_count,
             count(*) FILTER (s.active) AS active_surgeons, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS total_cases
      FROM organizations o LEFT JOIN surgeons s ON s.org_id = o.id LEFT JOIN c ON c.surgeon_id = s.id GROUP BY 1, 2),
bill AS (SELECT *, (199 + 80 * active_surgeons) * 100 AS amount_cents FROM b)
"""


def _bills(spark, sf):
    return usage.billing_for_period(
        bound(spark, sf, "organizations"), bound(spark, sf, "surgeons"), bound(spark, sf, "pa_cases"), *MONTH
    )


@query("billing_one_month", _BILL + "SELECT * FROM bill")
def billing_one_month(spark, sf):
    return _bills(spark, sf)


@query("billing_drift", _BILL + "SELECT * FROM bill WHERE last_acknowledged_surgeon_count IS DISTINCT FROM active_surgeons")
def billing_drift(spark, sf):
    return usage.billing_drift(_bills(spark, sf))


@query("billing_all_months", f"""
WITH {cte('surgeons', 'pa_cases')},
r AS (SELECT org_id, count(*) FILTER (active) AS active_surgeons FROM surgeons GROUP BY 1)
SELECT s.org_id, strftime(c.created_at, '%Y-%m') AS month, r.active_surgeons, count(*) AS total_cases,
       (199 + 80 * r.active_surgeons) * 100 AS amount_cents
FROM pa_cases c JOIN surgeons s ON s.id = c.surgeon_id JOIN r ON r.org_id = s.org_id GROUP BY 1, 2, 3
""")
def billing_all_months(spark, sf):
    return usage.billing_by_month(bound(spark, sf, "surgeons"), bound(spark, sf, "pa_cases"))


@query("surgeon_usage", f"""
WITH {cte('surgeons', 'pa_cases')}
SELECT s.org_id, s.id AS surgeon_id, s.full_name, s.active, count(c.id) AS case_count
FROM surgeons s LEFT JOIN pa_cases c ON c.surgeon_id = s.id GROUP BY 1, 2, 3, 4
""")
def surgeon_usage(spark, sf):
    return usage.surgeon_usage(bound(spark, sf, "surgeons"), bound(spark, sf, "pa_cases"))


@query("month_bounds", f"""
WITH {cte('pa_cases')}
SELECT strftime(date_trunc('month', created_at), '%Y-%m-%d') AS period_start,
       strftime(date_trunc('month', created_at) + INTERVAL 1 MONTH, '%Y-%m-%d') AS period_end, count(*) AS n
FROM pa_cases GROUP BY 1, 2
""")
def month_bounds(spark, sf):
    start = usage.month_of("created_at")
    return bound(spark, sf, "pa_cases").groupBy(
        F.date_format(start, "yyyy-MM-dd").alias("period_start"),
        F.date_format(F.add_months(start, 1), "yyyy-MM-dd").alias("period_end"),
    ).agg(F.count("*").alias("n"))


@query("cases_in_own_org", f"""
WITH {cte('surgeons', 'pa_cases')}
SELECT org_id, count(*) AS n FROM pa_cases c
WHERE EXISTS (SELECT 1 FROM surgeons s WHERE s.id = c.surgeon_id AND s.org_id = c.org_id) GROUP BY 1
""")
def cases_in_own_org(spark, sf):
    own = access.in_own_org(bound(spark, sf, "pa_cases"), bound(spark, sf, "surgeons"))
    return own.groupBy("org_id").agg(F.count("*").alias("n"))


@query("current_memberships", f"""
WITH {cte('users', 'memberships', 'organizations')}
SELECT u.user_id, u.email, m.org_id, m.role, o.name AS org_name
FROM users u JOIN memberships m ON m.user_id = u.user_id JOIN organizations o ON o.id = m.org_id
""")
def current_memberships(spark, sf):
    return access.current_memberships(
        bound(spark, sf, "users"), bound(spark, sf, "memberships"), bound(spark, sf, "organizations")
    ).select("user_id", "email", "org_id", "role", "org_name")


@query("role_gate", f"""
WITH {cte('memberships')}
SELECT org_id, role, count(*) AS n FROM memberships WHERE role IN ('owner', 'coordinator') GROUP BY 1, 2
""")
def role_gate(spark, sf):
    allowed = bound(spark, sf, "memberships").where(access.has_role("owner", "coordinator"))
    return allowed.groupBy("org_id", "role").agg(F.count("*").alias("n"))


_PENDING = f"""
WITH {cte('users', 'memberships', 'invitations')},
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY created_at, id) AS rn
                     FROM invitations WHERE accepted_at IS NULL) WHERE rn = 1)
"""


@query("oldest_pending_invitation", _PENDING + "SELECT email, id AS invitation_id, org_id, role FROM p")
def oldest_pending_invitation(spark, sf):
    return access.oldest_pending_invitation(bound(spark, sf, "invitations"))


@query("landing_page", _PENDING + """
SELECT u.user_id, p.id AS invitation_id, CASE WHEN p.id IS NULL THEN '/onboarding' ELSE '/invite/accept' END AS destination
FROM users u LEFT JOIN p ON p.email = u.email WHERE u.user_id NOT IN (SELECT user_id FROM memberships)""")
def landing_page(spark, sf):
    return access.landing_page(*(bound(spark, sf, t) for t in ("users", "memberships", "invitations")))


@query("accepted_invitations", _PENDING + """
SELECT u.user_id, p.org_id, p.role, p.id AS invitation_id
FROM users u JOIN p ON p.email = u.email WHERE u.user_id NOT IN (SELECT user_id FROM memberships)""")
def accepted_invitations(spark, sf):
    return access.accept_invitations(*(bound(spark, sf, t) for t in ("users", "memberships", "invitations")))


def _tenant_tables(spark, sf):
    orgs = bound(spark, sf, "organizations").withColumnRenamed("id", "org_id")
    return {
        "organizations": (orgs, False), "memberships": (bound(spark, sf, "memberships"), False),
        "surgeons": (bound(spark, sf, "surgeons"), False), "invitations": (bound(spark, sf, "invitations"), True),
        "pa_cases": (bound(spark, sf, "pa_cases"), False),
    }


_TENANT = f"""
WITH {cte('organizations', 'memberships', 'surgeons', 'invitations', 'pa_cases')},
t AS (SELECT 'organizations' AS "table", id AS org_id, false AS owners FROM organizations
      UNION ALL SELECT 'memberships', org_id, false FROM memberships UNION ALL SELECT 'surgeons', org_id, false FROM surgeons
      UNION ALL SELECT 'invitations', org_id, true FROM invitations UNION ALL SELECT 'pa_cases', org_id, false FROM pa_cases)
"""


@query("tenant_visible_rows", _TENANT + """
, g AS (SELECT "table", org_id, owners, count(*) AS n FROM t GROUP BY 1, 2, 3)
SELECT m.user_id, g."table", g.n FROM memberships m JOIN g ON g.org_id = m.org_id AND (NOT g.owners OR m.role = 'owner')""")
def tenant_visible_rows(spark, sf):
    return access.visible_counts(_tenant_tables(spark, sf), bound(spark, sf, "memberships"))


@query("tenant_leak_audit", _TENANT + """
SELECT "table", count(*) FILTER (EXISTS (SELECT 1 FROM memberships m WHERE m.org_id = t.org_id AND m.user_id = NULL)) AS visible
FROM t GROUP BY 1""")
def tenant_leak_audit(spark, sf):
    return access.leak_audit(_tenant_tables(spark, sf), bound(spark, sf, "memberships"))


_SIGNUPS = f"""
WITH {cte('waitlist')},
s AS (SELECT id, lower(trim(raw_email)) AS email, nullif(trim(practice_name), '') AS practice_name, created_s,
             CASE WHEN length(honey) > 0 THEN 'bot'
                  WHEN raw_email IS NULL OR NOT regexp_matches(lower(trim(raw_email)), '^\\S+@\\S+\\.\\S+$') THEN 'invalid' ELSE 'ok' END AS status
      FROM waitlist)
"""


@query("signup_checks", _SIGNUPS + "SELECT * FROM s")
def signup_checks(spark, sf):
    return access.signup_requests(bound(spark, sf, "waitlist"))


@query("signup_insert_unique", _SIGNUPS + """
, f AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY created_s, id) AS rn FROM s WHERE status = 'ok' AND id % 7 <> 0)
SELECT email, id, practice_name, created_s, status FROM f
WHERE rn = 1 AND email NOT IN (SELECT email FROM s WHERE id % 7 = 0)""")
def signup_insert_unique(spark, sf):
    """Rows with id % 7 = 0 stand for what is stored already; the rest arrive."""
    checked = access.signup_requests(bound(spark, sf, "waitlist"))
    stored, arriving = checked.where("id % 7 = 0"), checked.where("status = 'ok' AND id % 7 <> 0")
    return access.insert_unique(arriving, stored, "email", "created_s")


@query("waitlist_stage_update", f"""
WITH {cte('waitlist')}
SELECT id, CASE WHEN unsubscribed = false AND email_stage = 1 THEN 3 ELSE email_stage END AS email_stage FROM waitlist""")
def waitlist_stage_update(spark, sf):
    signups = bound(spark, sf, "waitlist").select("id", "email_stage", "unsubscribed")
    sent = access.mailable(signups, 1).select("id", F.lit(3).cast("bigint").alias("email_stage"))
    return access.keyed_update(signups, "id", sent, "email_stage").drop("unsubscribed")


@query("surgeon_deactivation", f"""
WITH {cte('surgeons', 'pa_cases')}
SELECT id, org_id, active AND id IN (SELECT surgeon_id FROM pa_cases WHERE created_at >= TIMESTAMP '2000-01-01') AS active FROM surgeons""")
def surgeon_deactivation(spark, sf):
    """Surgeons without a case since 2000 are set inactive."""
    surgeons = bound(spark, sf, "surgeons").select("id", "org_id", "active")
    recent = bound(spark, sf, "pa_cases").where("created_at >= TIMESTAMP '2000-01-01'").select(F.col("surgeon_id").alias("id"))
    idle = surgeons.join(recent, "id", "left_anti").select("id", F.lit(False).alias("active"))
    return access.keyed_update(surgeons, "id", idle, "active")


@query("waitlist_count", f"WITH {cte('waitlist')} SELECT count(*) AS n FROM waitlist")
def waitlist_count(spark, sf):
    return bound(spark, sf, "waitlist").agg(F.count("*").alias("n"))


@query("waitlist_position", f"""
WITH {cte('waitlist')}
SELECT id, CAST(count(*) OVER (ORDER BY created_s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS position FROM waitlist""")
def waitlist_position(spark, sf):
    return usage.position_by_time(bound(spark, sf, "waitlist").select("id", "created_s"), "created_s", 3600).select("id", "position")


@query("waitlist_stage_filter", f"""
WITH {cte('waitlist')} SELECT id, email_stage FROM waitlist WHERE email_stage = 1 AND unsubscribed <> true""")
def waitlist_stage_filter(spark, sf):
    return access.mailable(bound(spark, sf, "waitlist"), 1).select("id", "email_stage")


@query("email_batches", f"""
WITH {cte('waitlist')}
SELECT id, substr(sha256(lower(trim(raw_email))), 1, 12) AS email_hash,
       CAST(floor((row_number() OVER (ORDER BY id) - 1) / 50) AS BIGINT) AS batch
FROM waitlist WHERE email_stage = 1 AND unsubscribed <> true""")
def email_batches(spark, sf):
    chosen = access.mailable(bound(spark, sf, "waitlist"), 1).select(
        "id", F.substring(F.sha2(F.lower(F.trim("raw_email")), 256), 1, 12).alias("email_hash")
    )
    return usage.send_batches(chosen, "id")


@query("roster_in_order", f"""
WITH {cte('surgeons')} SELECT org_id, full_name, id FROM surgeons WHERE active ORDER BY full_name""")
def roster_in_order(spark, sf):
    return bound(spark, sf, "surgeons").where("active").select("org_id", "full_name", "id").orderBy("full_name")


@query("newest_case", f"""
WITH {cte('pa_cases')} SELECT id, org_id, strftime(created_at, '%Y-%m-%d') AS created FROM pa_cases ORDER BY created_at DESC, id DESC, org_id LIMIT 1""")
def newest_case(spark, sf):
    top = bound(spark, sf, "pa_cases").orderBy(F.desc("created_at"), F.desc("id"), "org_id").limit(1)
    return top.select("id", "org_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))
