"""Deliveries in batch: admission, deduplication, horizons, claims and leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def admission(received: Column, issued: Column, now: int, max_age: int, skew: int) -> Column:
    """Why a delivery is refused (seconds since the epoch); null if it is admitted."""
    return (
        F.when(received < now - max_age, "received-late")
        .when(received > now + skew, "received-early")
        .when(issued > now + skew, "issued-early")
        .when(issued < received - max_age, "issued-late")
        .when(issued > received + skew, "issued-after-receipt")
    )


def deduplicated(rows: DataFrame, key: list[str], order: list[str], digest: str) -> DataFrame:
    """rows with `outcome`: first, duplicate (same digest as the first) or conflict.

    The first of each key is found by an aggregation that combines before it shuffles, not by a window.
    """
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, digest)).alias("_first"))
    is_first = F.struct(*order) == F.struct(*[F.col(f"_first.{c}") for c in order])
    outcome = F.when(is_first, "first").when(F.col(digest).eqNullSafe(F.col(f"_first.{digest}")), "duplicate").otherwise("conflict")
    return rows.join(first, key).withColumn("outcome", outcome).drop("_first")


def keep_through(issued: Column, max_age: int, max_queue: int, permanent: Column) -> Column:
    """Until when a replay must be recognised; null for ever."""
    return F.when(~permanent, issued + max_age + max_queue)


def claimable(rows: DataFrame, now: int) -> DataFrame:
    """One row (claimed, wake_at): the least ready key, or when the next one is ready."""
    return rows.agg(
        F.min(F.when(F.col("ready_at") <= now, F.col("key"))).alias("claimed"),
        F.min(F.when(F.col("ready_at") > now, F.col("ready_at"))).alias("wake_at"),
    ).select("claimed", F.when(F.col("claimed").isNull(), F.col("wake_at")).alias("wake_at"))


def lease_states(log: DataFrame, key: str, lease: int) -> DataFrame:
    """Final state of each key after its events in order of (at, event_id): a fold of the sorted log.

    claim takes a new or expired key and raises the fence; claim on a live lease of another owner is
    busy; complete by the live owner ends it; anything after the end is a duplicate.
    """
    folded = F.aggregate(
        F.array_sort("events"),
        F.expr("named_struct('state', 'new', 'owner', cast(null as string), 'fence', 0L, 'until', 0L, 'busy', 0L, 'duplicates', 0L)"),
        lambda s, e: (
            F.when(
                s["state"] == "done",
                F.struct(s["state"].alias("state"), s["owner"].alias("owner"), s["fence"].alias("fence"), s["until"].alias("until"), s["busy"].alias("busy"), (s["duplicates"] + 1).alias("duplicates")),
            )
            .when(
                (e["kind"] == "claim") & ((s["state"] == "new") | (e["at"] >= s["until"])),
                F.struct(F.lit("running").alias("state"), e["owner"].alias("owner"), (s["fence"] + 1).alias("fence"), (e["at"] + lease).alias("until"), s["busy"].alias("busy"), s["duplicates"].alias("duplicates")),
            )
            .when(
                (e["kind"] == "complete") & (s["state"] == "running") & (e["owner"] == s["owner"]) & (e["at"] < s["until"]),
                F.struct(F.lit("done").alias("state"), s["owner"].alias("owner"), s["fence"].alias("fence"), s["until"].alias("until"), s["busy"].alias("busy"), s["duplicates"].alias("duplicates")),
            )
            .otherwise(
                F.struct(s["state"].alias("state"), s["owner"].alias("owner"), s["fence"].alias("fence"), s["until"].alias("until"), (s["busy"] + 1).alias("busy"), s["duplicates"].alias("duplicates"))
            )
        ),
    )
    events = log.groupBy(key).agg(F.collect_list(F.struct("at", "event_id", "kind", "owner")).alias("events"))
    return events.select(key, folded.alias("s")).select(key, "s.state", "s.fence", "s.busy", "s.duplicates")


def publication(runner: Column, revoked: Column, closed: Column, superseded: Column) -> Column:
    """revoked > closed > superseded > what the runner said."""
    return F.when(revoked, "revoked").when(closed, "closed").when(superseded, "superseded").otherwise(runner)


def plan_binding(rows: DataFrame, plans: DataFrame, scope: list[str]) -> DataFrame:
    """rows with the one plan of their scope; `binding` says bound, unplanned or ambiguous."""
    one = plans.groupBy(*scope).agg(F.count("*").alias("_n"), F.min("plan").alias("plan"))
    binding = F.when(F.col("_n").isNull(), "unplanned").when(F.col("_n") > 1, "ambiguous").otherwise("bound")
    return rows.join(one, scope, "left").withColumn("binding", binding).withColumn("plan", F.when(F.col("binding") == "bound", F.col("plan"))).drop("_n")


def budget_crossing(rows: DataFrame, by: str, order: str, cost: str, limit: int) -> DataFrame:
    """(by, order, total, crossing): the first row of each group whose running cost is above the limit.

    Costs are summed per hash-free range of the order first, so only the crossing range is sorted.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    prefix = F.substring(order, 1, 12)
    ranges = rows.groupBy(by, prefix.alias("_r")).agg(F.sum(cost).alias("_sum"))
    up = Window.partitionBy(by).orderBy("_r")
    hit = (
        ranges.withColumn("_upto", F.sum("_sum").over(up))
        .filter((F.col("_upto") > limit) & (F.col("_upto") - F.col("_sum") <= limit))
        .select(by, "_r", (F.col("_upto") - F.col("_sum")).alias("_before"))
    )
    return (
        rows.withColumn("_r", prefix)
        .join(hit, [by, "_r"])
        .withColumn("total", F.col("_before") + F.sum(cost).over(w))
        .filter((F.col("total") > limit) & (F.col("total") - F.col(cost) <= limit))
        .select(by, order, (F.col("total") - F.col(cost)).alias("before"), F.col(cost).alias("crossing"))
    )
