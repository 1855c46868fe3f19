"""Aggregates over usage and interaction logs. Every function is DataFrame -> DataFrame; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.prices import DEFAULT_PRICE, LOCAL_PREFIX, MODEL_PRICES
from quern.sources.adapters import now


def within(column: str, as_of: str, **span: int) -> Column:
    """column in (as_of - span, as_of]: a plain range, so it reaches the scan."""
    return (F.col(column) > now(as_of) - F.make_dt_interval(**{k: F.lit(v) for k, v in span.items()})) & (F.col(column) <= now(as_of))


def on_day(column: str, as_of: str, back: int = 0) -> Column:
    """column on the day ``back`` days before that of as_of, as a range."""
    day = now(as_of).cast("date").cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(back))
    return (F.col(column) >= day) & (F.col(column) < day + F.make_dt_interval(days=F.lit(1)))


def total(column, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.sum(column), F.lit(0.0)), digits)


def usage_by_model(usage: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return usage.where(within("ts", as_of, days=days)).groupBy("model").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cache_read_tokens").alias("cache_read_tokens"), total("cost_usd").alias("cost"), F.count("*").alias("calls"),
    )


def daily_usage(usage: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    return usage.where(within("ts", as_of, days=days)).groupBy(F.col("ts").cast("date").alias("day")).agg(total("cost_usd").alias("cost"), F.count("*").alias("calls")).orderBy("day")


def period_stats(usage: DataFrame, as_of: str) -> DataFrame:
    """Cost and calls of today, yesterday and the last hour in one scan."""
    spans = {"today": on_day("ts", as_of), "yesterday": on_day("ts", as_of, 1), "hour": within("ts", as_of, hours=1)}
    some = usage.where((F.col("ts") >= now(as_of) - F.make_dt_interval(days=F.lit(3))))
    return some.agg(*(x for k, c in spans.items() for x in (total(F.when(c, F.col("cost_usd"))).alias(f"{k}_cost"), F.count_if(c).alias(f"{k}_calls"))))


def totals(usage: DataFrame) -> DataFrame:
    return usage.agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"), total("cost_usd", 2).alias("total_cost_usd"), F.count("*").alias("total_calls"),
    )


def success_rate(log: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Percentage of successes, 100 where there is no row."""
    return log.where(within("created_at", as_of, hours=hours)).agg(F.round(F.coalesce(100 * F.avg("success"), F.lit(100.0)), 1).alias("success_rate"))


def average_confidence(log: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return log.where(within("created_at", as_of, hours=hours) & F.col("confidence").isNotNull()).agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 1).alias("avg_confidence"))


def cache_efficiency(usage: DataFrame) -> DataFrame:
    return usage.agg(F.round(F.coalesce(F.try_divide(F.sum("cache_read_tokens") * 100.0, F.sum("input_tokens")), F.lit(0.0)), 1).alias("cache_efficiency"))


def model_distribution(usage: DataFrame, as_of: str) -> DataFrame:
    return usage.where(on_day("ts", as_of)).groupBy("model").agg(F.count("*").alias("calls"), total("cost_usd").alias("cost")).orderBy(F.desc("calls"), "model")


def queue_stats(queue: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows by task type and status, one column a status, with a total row."""
    wide = queue.groupBy("task_type").pivot("status", statuses).count()
    each = wide.select("task_type", *(F.coalesce(F.col(s), F.lit(0)).alias(s) for s in statuses))
    return each.unionByName(each.agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in statuses)).withColumn("task_type", F.lit("all")))


def health(usage: DataFrame, log: DataFrame, as_of: str, budget: float) -> DataFrame:
    """KPIs and the composite health status."""
    ok = success_rate(log, as_of)
    today = period_stats(usage, as_of)
    both = ok.join(F.broadcast(today))  # one row each
    share = F.round(F.col("today_cost") / budget * 100, 1) if budget > 0 else F.lit(0.0)
    error = F.round(100 - F.col("success_rate"), 1)
    status = F.when((error > 20) | (share > 90), "down").when((error > 10) | (share > 70), "degraded").otherwise("healthy")
    return both.select("success_rate", "today_cost", "today_calls", "yesterday_cost", "yesterday_calls", error.alias("error_rate"), share.alias("budget_pct"), status.alias("status"))


def priced(usage: DataFrame, prices=MODEL_PRICES, default=DEFAULT_PRICE) -> DataFrame:
    """``usage`` with ``cost``: prices by exact model, then local models (a prefix, or a tag after a colon) for free, then the default.

    Tokens that a cache is filled with (``cache_creation_tokens``, if there is such a column) cost as much as input.
    """
    dim = usage.sparkSession.createDataFrame(list(prices), "_model string, p_in double, p_out double, p_cache double")
    local = F.col("model").startswith(LOCAL_PREFIX) | F.col("model").contains(":")
    price = lambda c, k: F.coalesce(F.col(c), F.when(local, 0.0).otherwise(default[k]))
    joined = usage.join(F.broadcast(dim), F.col("model") == F.col("_model"), "left")  # a price list of fixed size
    fill = F.coalesce(F.col("cache_creation_tokens"), F.lit(0)) if "cache_creation_tokens" in usage.columns else F.lit(0)
    cost = (F.col("input_tokens") + fill) * price("p_in", 0) + F.col("output_tokens") * price("p_out", 1) + F.col("cache_read_tokens") * price("p_cache", 2)
    return joined.select(*usage.columns, (cost / 1_000_000).alias("cost"))


def budget_gate(usage: DataFrame, budget: float) -> DataFrame:
    """Each call with the day's cost so far and whether the budget was spent before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", F.col("ts").cast("date")).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost_usd").over(w), F.lit(0.0))
    return usage.select("id", "user_id", "ts", F.round(spent, 4).alias("spent"), (F.round(spent, 4) >= budget).alias("blocked"))
