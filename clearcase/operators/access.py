"""Organization access: membership lookups, invitations, tenant visibility, keyed writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_memberships(users: DataFrame, memberships: DataFrame, organizations: DataFrame) -> DataFrame:
    """User, membership and organization; users missing either are absent."""
    orgs = organizations.select(F.col("id").alias("org_id"), F.col("name").alias("org_name"))
    return users.join(memberships.select("user_id", "org_id", "role"), "user_id").join(orgs, "org_id")


def has_role(*allowed: str) -> Column:
    return F.col("role").isin(*allowed)


def oldest_pending_invitation(invitations: DataFrame) -> DataFrame:
    """The earliest open invitation per address; min_by combines map-side, so no hot address."""
    first = F.min_by(F.struct("id", "org_id", "role"), F.struct("created_at", "id"))
    return (
        invitations.where(F.col("accepted_at").isNull()).groupBy("email").agg(first.alias("i"))
        .select("email", F.col("i.id").alias("invitation_id"), "i.org_id", "i.role")
    )


def landing_page(users: DataFrame, memberships: DataFrame, invitations: DataFrame) -> DataFrame:
    """Where a user without a membership goes next; members have no row."""
    pending = oldest_pending_invitation(invitations)
    outside = users.join(memberships.select("user_id"), "user_id", "left_anti")
    return outside.join(pending, "email", "left").select(
        "user_id", "invitation_id",
        F.when(F.col("invitation_id").isNull(), "/onboarding").otherwise("/invite/accept").alias("destination"),
    )


def accept_invitations(users: DataFrame, memberships: DataFrame, invitations: DataFrame) -> DataFrame:
    """New memberships: pending, address matches, not a member yet, one organization per user."""
    outside = users.join(memberships.select("user_id"), "user_id", "left_anti")
    return outside.join(oldest_pending_invitation(invitations), "email").select("user_id", "org_id", "role", "invitation_id")


def in_own_org(cases: DataFrame, surgeons: DataFrame) -> DataFrame:
    """Cases whose surgeon belongs to the case's organization."""
    roster = surgeons.select(F.col("id").alias("surgeon_id"), "org_id")
    return cases.join(roster, ["surgeon_id", "org_id"], "left_semi")


def visible_to(rows: DataFrame, memberships: DataFrame, user_id: int | None, owners_only: bool = False) -> DataFrame:
    """Rows of the organizations the user belongs to; an anonymous user sees none."""
    mine = memberships.where(F.col("user_id") == F.lit(user_id).cast("bigint"))
    if owners_only:
        mine = mine.where(has_role("owner"))
    return rows.join(mine.select("org_id").distinct(), "org_id", "left_semi")


def visible_counts(tables: dict[str, tuple[DataFrame, bool]], memberships: DataFrame) -> DataFrame:
    """Rows each member can see per table.

    Tables are counted per organization before the join, so the join carries
    one row per (member, table) however large an organization is.
    """
    def one(name: str, rows: DataFrame, owners_only: bool) -> DataFrame:
        counts = rows.groupBy("org_id").agg(F.count("*").alias("n"))
        members = memberships.where(has_role("owner")) if owners_only else memberships
        return members.select("user_id", "org_id").join(counts, "org_id").select("user_id", F.lit(name).alias("table"), "n")

    return reduce(DataFrame.unionByName, [one(n, df, o) for n, (df, o) in tables.items()])


def leak_audit(tables: dict[str, tuple[DataFrame, bool]], memberships: DataFrame) -> DataFrame:
    """Row counts an anonymous caller can see; every count must be 0."""
    def one(name: str, rows: DataFrame, owners_only: bool) -> DataFrame:
        seen = visible_to(rows, memberships, None, owners_only)
        return seen.agg(F.count("*").alias("visible")).select(F.lit(name).alias("table"), "visible")

    return reduce(DataFrame.unionByName, [one(n, df, o) for n, (df, o) in tables.items()])


def signup_requests(raw: DataFrame) -> DataFrame:
    """Checked signups with a status; bots are told nothing and stored nowhere."""
    email = F.lower(F.trim("raw_email"))
    return raw.select(
        "id", email.alias("email"), F.expr("nullif(trim(practice_name), '')").alias("practice_name"), "created_s",
        F.when(F.coalesce(F.length("honey"), F.lit(0)) > 0, "bot")
        .when(F.col("raw_email").isNull() | ~email.rlike(r"^\S+@\S+\.\S+$"), "invalid")
        .otherwise("ok").alias("status"),
    )


def insert_unique(new_rows: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append under a unique key: the earliest per key that is not stored yet."""
    others = [c for c in new_rows.columns if c != key]
    first = new_rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(order, "id")).alias("r")).select(key, "r.*")
    return first.join(existing.select(key), key, "left_anti")


def keyed_update(rows: DataFrame, key: str, updates: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """``column`` replaced where ``updates`` has the key; other rows unchanged.

    Of several updates of one key the last by ``order`` counts; without an order, and on ties, the greatest value does.
    """
    last = F.struct(*([order] if order else []), column)
    change = updates.groupBy(key).agg(F.max(last)[column].alias("_new"), F.lit(True).alias("_hit"))
    return rows.join(change, key, "left").withColumn(
        column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))
    ).drop("_new", "_hit")


def mailable(signups: DataFrame, stage: int) -> DataFrame:
    """Signups at ``stage``; a null ``unsubscribed`` drops out, as three-valued logic has it."""
    return signups.where((F.col("email_stage") == stage) & (F.col("unsubscribed") != F.lit(True)))
