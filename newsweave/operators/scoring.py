"""Topic rollup, trending score, quality gates, selection quotas and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave import params as P
from newsweave.functions import text as X, times as T


def topic_rollup(members: DataFrame, now: Column) -> DataFrame:
    """Members(topic_id, source_id, angle, item_at) to one row per topic.

    Rows are first reduced per topic and source, so that a topic holding a
    large part of all items reaches its final task as one row per source.
    """
    recent = F.col("item_at") >= now - F.expr(f"INTERVAL {P.VELOCITY_HOURS} HOURS")
    per_source = members.groupBy("topic_id", "source_id", "angle").agg(
        F.count("*").alias("n"),
        F.count_if(recent).alias("n_recent"),
        F.min("item_at").alias("first_at"),
        F.max("item_at").alias("last_at"),
    )
    return per_source.groupBy("topic_id").agg(
        F.sum("n").alias("size"),
        F.size(F.collect_set("source_id")).alias("distinct_sources"),
        F.array_sort(F.collect_set("angle")).alias("angles"),
        F.min("first_at").alias("first_item_at"),
        F.max("last_at").alias("last_item_at"),
        F.sum("n_recent").alias("recent_items"),
    ).withColumn("distinct_angles", F.size("angles"))


def trending_score(
    sources: Column, angles: Column, recent: Column, newest: Column, now: Column
) -> Column:
    """Sources x viewpoint spread x growth x freshness, rounded to cents.

    Freshness falls to 1/e (not to one half) after FRESHNESS_HOURS.
    """
    angle_factor = 1 + 0.5 * F.greatest(F.lit(0), angles - 1)
    velocity = 1 + recent / 2
    quiet_hours = F.greatest(F.lit(0.0), T.hours_between(now, F.coalesce(newest, now)))
    freshness = F.exp(-quiet_hours / P.FRESHNESS_HOURS)
    return T.round_half_up(sources * angle_factor * velocity * freshness, 2)


def with_trending(topics: DataFrame, now: Column) -> DataFrame:
    score = trending_score(
        F.col("distinct_sources"),
        F.col("distinct_angles"),
        F.col("recent_items"),
        F.col("last_item_at"),
        now,
    )
    return topics.withColumn("trending_score", score)


def gate_reasons(gates: P.GateParams = P.GateParams()) -> Column:
    """Why a topic may not become an article; empty when it may."""
    reason = lambda bad, *parts: F.when(bad, F.concat(*parts))
    sources, angles, size = F.col("distinct_sources"), F.col("distinct_angles"), F.col("size")
    checks = F.array(
        reason(
            sources < gates.min_sources,
            F.lit("javlja je "), sources,
            F.lit(f" izvora, traži se najmanje {gates.min_sources}"),
        ),
        reason(
            angles < gates.min_angles,
            F.lit("pokriven je "), angles,
            F.lit(f" ugao, traži se najmanje {gates.min_angles} različita"),
        ),
        reason(
            size < gates.min_items,
            F.lit("ima "), size,
            F.lit(f" tekstova, traži se najmanje {gates.min_items}"),
        ),
    )
    return F.filter(checks, lambda r: r.isNotNull())


def with_gates(topics: DataFrame, gates: P.GateParams = P.GateParams()) -> DataFrame:
    return topics.withColumn("reasons", gate_reasons(gates)).withColumn(
        "passes", F.size("reasons") == 0
    )


def length_gate(articles: DataFrame, gates: P.GateParams = P.GateParams()) -> DataFrame:
    """Too short a text is not published and sends its topic to the stronger tier."""
    return articles.withColumn("word_count", article_words()).withColumn(
        "needs_flagship", F.col("word_count") < gates.min_words
    )


def article_words() -> Column:
    """Words of an article: its lead and its body."""
    return X.count_words(F.concat_ws(" ", "lead", "body"))


# --- daily counters and selection ----------------------------------------------------


def daily_output(articles: DataFrame) -> DataFrame:
    """Articles written and written by the stronger tier, per UTC day."""
    return articles.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("written"),
        F.count_if(F.col("model") == "flagship").alias("flagship_written"),
    )


def updates_on(articles: DataFrame, now: Column) -> DataFrame:
    day = F.date_trunc("day", now)
    return articles.agg(
        F.count_if((F.col("last_update_at") >= day) & (F.col("last_update_at") < now)).alias(
            "updates_today"
        )
    )


def monthly_spend(articles: DataFrame) -> DataFrame:
    return articles.groupBy(F.date_trunc("month", "created_at").alias("month")).agg(
        F.sum(F.col("cost_usd").cast("decimal(20,6)")).alias("spend")
    )


def spend_this_month(articles: DataFrame, now: Column) -> DataFrame:
    start = F.date_trunc("month", now)
    this_month = articles.filter((F.col("created_at") >= start) & (F.col("created_at") <= now))
    return this_month.agg(
        F.coalesce(F.sum(F.col("cost_usd").cast("decimal(20,6)")), F.lit(0)).alias("spend")
    )


def quota_state(articles: DataFrame, now: Column, limits: P.LimitParams) -> DataFrame:
    """One row: room left today, stronger-tier room, whether the daily limit binds, budget."""
    day = F.date_trunc("day", now)
    today = (F.col("created_at") >= day) & (F.col("created_at") <= now)
    month = (F.col("created_at") >= F.date_trunc("month", now)) & (F.col("created_at") <= now)
    updated = (F.col("last_update_at") >= day) & (F.col("last_update_at") <= now)
    counters = articles.agg(
        F.count_if(today).alias("written"),
        F.count_if(updated).alias("updated"),
        F.count_if(today & (F.col("model") == "flagship")).alias("flagship"),
        F.coalesce(F.sum(F.when(month, F.col("cost_usd")).cast("decimal(20,6)")), F.lit(0)).alias(
            "spend"
        ),
    )
    left = F.greatest(F.lit(0), F.lit(limits.per_day) - F.col("written") - F.col("updated"))
    return counters.select(
        (F.col("written") + F.col("updated")).alias("written_today"),
        F.when(F.col("spend") >= limits.monthly_budget, F.lit(0))
        .otherwise(F.least(F.lit(limits.per_run), left))
        .cast("int")
        .alias("room"),
        (left <= limits.per_run).alias("daily_binds"),
        F.greatest(F.lit(0), F.lit(limits.flagship_per_day) - F.col("flagship")).alias(
            "flagship_left"
        ),
        (F.col("spend") >= limits.monthly_budget).alias("over_budget"),
    )


def select_topics(
    candidates: DataFrame, quota: DataFrame, limits: P.LimitParams = P.LimitParams()
) -> DataFrame:
    """Choose topics under the quotas; every candidate keeps its decision and reasons.

    Candidates carry ``passes`` and ``reasons`` from the gates. Only the best
    ``per_run`` passing topics can be chosen, so they come from a top-k (one
    small row set); the ranking never sorts the whole table in one task.
    """
    best = (
        candidates.filter("passes")
        .orderBy(F.desc("trending_score"), "topic_id")
        .limit(limits.per_run)
        .select("topic_id", "trending_score", "needs_flagship")
    )
    order = Window.orderBy(F.desc("trending_score"), "topic_id")
    plain = F.when(F.col("needs_flagship"), 0).otherwise(1)
    ranked = (
        best.withColumn("rank", F.row_number().over(order))
        # Topics that must go to the stronger tier do not use up its quota.
        .withColumn("plain_rank", F.sum(plain).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .select("topic_id", "rank", "plain_rank")
    )
    # Both sides are bounded: at most per_run rows and exactly one row.
    joined = candidates.join(F.broadcast(ranked), "topic_id", "left").join(F.broadcast(quota))
    chosen = F.col("passes") & (F.coalesce("rank", F.lit(limits.per_run + 1)) <= F.col("room"))
    strong = F.col("needs_flagship") | (F.col("plain_rank") <= F.col("flagship_left"))
    full = F.when(
        F.col("over_budget"), F.lit("mesečni budžet je dostignut")
    ).when(
        F.col("daily_binds"),
        F.concat(
            F.lit(f"dnevna granica od {limits.per_day} članaka je dostignuta (danas napisano "),
            F.col("written_today"),
            F.lit(")"),
        ),
    ).otherwise(F.lit(f"ciklus je popunjen ({limits.per_run} članaka)"))
    return joined.select(
        "topic_id",
        "trending_score",
        chosen.alias("selected"),
        F.when(chosen, F.when(strong, "flagship").otherwise("default")).alias("tier"),
        F.when(~F.col("passes"), F.col("reasons"))
        .when(chosen, F.array().cast("array<string>"))
        .otherwise(F.array(full))
        .alias("reasons"),
    )


def budget_cutoff(queue: DataFrame, budget: float, limit: int) -> DataFrame:
    """Work through the queue in order while the cost so far is below the budget.

    The check happens before a row runs, so the last one may overshoot. The
    queue is cut to its first ``limit`` rows (one run's allowance) by a top-k
    before the running sum, which therefore sees at most ``limit`` rows.
    """
    head = queue.orderBy("position_key", "id").limit(limit)
    before = Window.orderBy("position_key", "id").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost_usd").over(before), F.lit(0))
    return head.withColumn("spent_before", spent).withColumn(
        "runs", F.col("spent_before") < F.lit(budget)
    )


# --- cost ---------------------------------------------------------------------------------


def price_table(prices: P.PriceParams) -> tuple[Column, Column]:
    """Input and output price per million tokens for the row's model."""
    pick = lambda i: F.coalesce(
        F.create_map(
            *[F.lit(v) for name, price in prices.per_million.items() for v in (name, price[i])]
        )[F.col("model")],
        F.lit(prices.per_million["default"][i]),
    ).cast("decimal(10,2)")
    return pick(0), pick(1)


def usage_defaults(usage: DataFrame) -> DataFrame:
    counts = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
    return usage.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts})


def call_cost(
    usage: DataFrame, prices: P.PriceParams = P.PriceParams(), batch: bool = False
) -> DataFrame:
    """Exact decimal cost of each call; batch calls cost half on every component."""
    rows = usage_defaults(usage)
    per_input, per_output = price_table(prices)
    share = F.lit("0.5" if batch else "1").cast("decimal(3,2)")
    million = F.lit(1000000).cast("decimal(10,0)")

    def cost(tokens: str, price: Column, factor: str = "1") -> Column:
        amount = F.col(tokens).cast("decimal(14,0)") * price
        amount = amount.cast("decimal(20,2)") * F.lit(factor).cast("decimal(4,2)")
        return (amount.cast("decimal(20,4)") * share / million).cast("decimal(20,10)")

    return (
        rows.withColumn("input_cost", cost("input_tokens", per_input))
        .withColumn("output_cost", cost("output_tokens", per_output))
        .withColumn("cache_write_cost", cost("cache_creation_tokens", per_input, prices.cache_write))
        .withColumn("cache_read_cost", cost("cache_read_tokens", per_input, prices.cache_read))
        .withColumn(
            "total_cost",
            F.col("input_cost")
            + F.col("output_cost")
            + F.col("cache_write_cost")
            + F.col("cache_read_cost"),
        )
    )


def request_usage(calls: DataFrame) -> DataFrame:
    """Usage of a request answered in several calls, added up."""
    counts = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
    return usage_defaults(calls).groupBy("request_id", "model").agg(
        *[F.sum(c).alias(c) for c in counts]
    )


def model_comparison(costed: DataFrame, articles_per_day: int = 30) -> DataFrame:
    """Average cost per model and what a month at a fixed daily output would cost."""
    average = F.sum("total_cost") / F.count("*")
    return costed.groupBy("model").agg(
        F.count("*").alias("n_articles"),
        average.alias("average_cost"),
        (average * articles_per_day * 30).alias("monthly_estimate"),
    )
