"""Counters of an executed plan, from Spark's own SQL metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plan_counters(df: DataFrame) -> list[dict]:
    """Runs ``df`` once, discarding rows, and returns per plan node its metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count() if hasattr(plan, "execute") else df.count()
    return _walk(plan)


def _walk(plan) -> list[dict]:
    node = {"node": plan.nodeName()}
    it = plan.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        node[pair._1()] = pair._2().value()
    found, kids = [node], list(_children(plan))
    for child in kids:
        found += _walk(child)
    return found


def _children(plan):
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        yield plan.executedPlan()
        return
    if name in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage"):
        yield plan.plan()
        return
    it = plan.children().iterator()
    while it.hasNext():
        yield it.next()
