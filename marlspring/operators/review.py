"""Review states, audit logs, task progress, attempt gates and resumable work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspring.functions.scalars import share

#: The state after each action, and the states an action may start from.
AFTER = {"submit": "pending", "approve": "approved", "reject": "rejected", "restore": "pending", "delete": "deleted"}
FROM = {"submit": ["none", "rejected"], "approve": ["pending"], "reject": ["pending", "approved"], "restore": ["rejected", "deleted"], "delete": ["pending", "approved", "rejected"]}


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def current_state(log: DataFrame, item: str, order: list[str], action: str = "action") -> DataFrame:
    """item, state, n_actions: the state after the latest logged action."""
    return log.groupBy(item).agg(F.max_by(_map(AFTER)[F.col(action)], F.struct(*order)).alias("state"), F.count("*").alias("n_actions"))


def illegal_transitions(log: DataFrame, item: str, order: list[str], action: str = "action") -> DataFrame:
    """Log rows whose action may not start from the state before it; each row's state before is named."""
    w = Window.partitionBy(item).orderBy(*order)
    before = F.coalesce(F.lag(_map(AFTER)[F.col(action)]).over(w), F.lit("none"))
    ok = F.lit(False)
    for a, states in FROM.items():
        ok = ok | ((F.col(action) == a) & F.col("before").isin(states))
    return log.withColumn("before", before).where(~ok)


def state_shares(states: DataFrame, confidence: str, first: int, order: list[Column]) -> DataFrame:
    """One row: totals and shares in hundredths of a percent of each state, and the mean confidence of the first pending rows by an order."""
    n = lambda s: F.count_if(F.col("state") == s)
    totals = states.agg(F.count("*").alias("total"), *[n(s).alias(s) for s in ("pending", "approved", "rejected", "deleted")])
    top = states.where("state = 'pending'").orderBy(*order).limit(first).agg(F.avg(confidence).alias("avg_confidence"))
    out = totals.crossJoin(F.broadcast(top))  # one row each
    return out.select("*", *[F.floor(share(F.col(s), F.col("total")) * 10_000 + 0.5).cast("long").alias(f"{s}_share") for s in ("pending", "approved", "rejected")])


def task_progress(tasks: DataFrame, task: str, done: Column, ok: Column, updated: str, ref_ts: Column, stale_seconds: int = 300) -> DataFrame:
    """task, total, progress, success_rate, stale: no update for longer than a bound."""
    g = tasks.groupBy(task).agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(done & ok).alias("good"), F.max(updated).alias("last"))
    stale = (F.unix_micros(ref_ts.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) > stale_seconds * 1_000_000
    return g.select(task, "total", share(F.col("done"), F.col("total")).alias("progress"), share(F.col("good"), F.col("done")).alias("success_rate"), stale.alias("stale"))


def failure_budget(attempts: DataFrame, item: str, order: list[str], failed: Column, budget: int = 3) -> DataFrame:
    """Adds failures (before the row) and allowed: under the budget."""
    w = Window.partitionBy(item).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("failures", F.coalesce(F.sum(failed.cast("int")).over(w), F.lit(0)).cast("long")).withColumn("allowed", F.col("failures") < budget)


def attempt_gate(attempts: DataFrame, item: str, order: str, chunks: str) -> DataFrame:
    """Adds skipped: an earlier attempt of the item has the same chunks or a superset. A skipped attempt adds nothing, so all earlier ones count.

    An item's attempts are few by the failure budget; they are compared within the item only.
    """
    a, b = attempts.select(item, order, chunks), attempts.select(item, F.col(order).alias("_o"), F.col(chunks).alias("_c"))
    hit = a.join(b, item).where(F.col("_o") < F.col(order)).where(F.size(F.array_except(chunks, "_c")) == 0).select(item, order).distinct()
    return attempts.join(hit.withColumn("skipped", F.lit(True)), [item, order], "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """key, batch: runs of ``size`` rows in key order; numbered within ranges of the key, so no task sees all rows."""
    return rows.select(key, F.expr(f"{key} div {size}").alias("batch"))


def restorable(states: DataFrame) -> DataFrame:
    return states.where(F.col("state").isin("rejected", "deleted"))


def stale_candidates(documents: DataFrame, labelled: DataFrame, chunked: DataFrame, key: str) -> DataFrame:
    """key, reason: unprocessed documents, and processed ones without chunks."""
    done = documents.join(labelled.select(key).distinct(), key, "left_semi")
    return documents.join(labelled.select(key).distinct(), key, "left_anti").select(key, F.lit("unprocessed").alias("reason")).union(done.join(chunked.select(key).distinct(), key, "left_anti").select(key, F.lit("no_chunks").alias("reason")))
