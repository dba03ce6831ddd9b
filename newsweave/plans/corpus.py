"""Derived news tables as DataFrames; the Spark side of ``views.py``."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsweave.functions import times as T, urls as U
from newsweave.operators import scoring
from newsweave.sinks import materialize
from newsweave.plans import views as V


class Corpus:
    """The shared tables under one directory and the news tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.dir = sf_dir
        self.now = F.timestamp_seconds(F.lit(V.NOW))
        self.known_until = F.timestamp_seconds(F.lit(V.KNOWN_UNTIL))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy per row (text, markup).

        A small table may sit in fewer file splits than there are cores; only
        then its rows are dealt out. A large one is read in place.
        """
        frame = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)

    @property
    def events(self) -> DataFrame:
        # The stored times carry no zone; they are UTC instants.
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def items(self) -> DataFrame:
        base = self.spread("documents").selectExpr(
            "*",
            "CAST(substr(source, 4) AS INT) AS n",
            f"{V.HEADLINE} AS headline",
            f"{V.FETCHED} AS fetched_s",
        )
        return base.select(
            "doc_id",
            F.col("source").alias("source_id"),
            "n",
            F.expr(V.ANGLE.format(n="n")).alias("angle"),
            "lang",
            "n_chars",
            F.expr(V.TITLE).alias("title"),
            F.substring("text", 1, 200).alias("summary"),
            F.col("text").alias("content"),
            F.expr(V.URL).alias("url"),
            F.timestamp_seconds("fetched_s").alias("fetched_at"),
            F.timestamp_seconds(F.expr(V.PUBLISHED)).alias("published_at"),
        )

    @cached_property
    def timed(self) -> DataFrame:
        valid = T.reject_future(F.col("published_at"), self.now)
        return self.items.withColumn("item_at", T.effective_time(valid, F.col("fetched_at")))

    @cached_property
    def sources(self) -> DataFrame:
        per_source = self.items.groupBy("source_id").agg(
            F.any_value("n").alias("n"), F.any_value("angle").alias("angle")
        )
        off = self.now + F.expr("INTERVAL 6 HOURS")
        return per_source.withColumn(
            "homepage", F.concat(F.lit("https://portal"), F.col("n") % 4, F.lit(".example/"))
        ).withColumn("disabled_until", F.when(F.col("n") % 6 == 0, off))

    @cached_property
    def candidates(self) -> DataFrame:
        ranks = F.filter(
            F.array(
                F.when(F.col("n") % 5 != 0, 1), F.when(F.col("n") % 7 != 0, 2), F.lit(3)
            ),
            lambda r: r.isNotNull(),
        )
        return self.items.select(
            "doc_id", "source_id", "n", "url", "title", "summary", "published_at", "content",
            F.explode(ranks).alias("channel_rank"),
        ).withColumn("seq", F.col("doc_id") * 2 + F.col("channel_rank"))

    @property
    def known(self) -> DataFrame:
        return self.items.filter(F.col("fetched_at") < self.known_until)

    @property
    def new(self) -> DataFrame:
        return self.items.filter(F.col("fetched_at") >= self.known_until)

    @cached_property
    def links(self) -> DataFrame:
        return self.table("documents").select(
            F.expr(V.TOPIC).alias("topic_id"),
            "doc_id",
            F.timestamp_seconds(F.expr(V.FETCHED)).alias("added_at"),
        )

    @cached_property
    def members(self) -> DataFrame:
        """Items with their topic; the link is a function of the id, so no join is needed."""
        return self.timed.withColumn("topic_id", F.expr(V.TOPIC)).withColumn(
            "added_at", F.col("fetched_at")
        )

    @cached_property
    def rollup(self) -> DataFrame:
        extra = self.members.groupBy("topic_id").agg(
            F.min("added_at").alias("first_added_at"),
            F.min_by("title", "doc_id").alias("title_sample"),
        )
        rolled = scoring.topic_rollup(
            self.members.select("topic_id", "source_id", "angle", "item_at"), self.now
        )
        # Read by topics, articles and reports of one query: worked out once.
        return materialize(rolled.join(extra, "topic_id"), "rollup")

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.with_trending(self.rollup, self.now)

    @cached_property
    def articles(self) -> DataFrame:
        passing = scoring.with_gates(self.rollup).filter("passes").filter(
            F.col("first_added_at") < self.now - F.expr("INTERVAL 12 HOURS")
        )
        labels = self.table("labels").select("doc_id", "toxic")
        material = (
            self.members.select("topic_id", "doc_id", "n_chars", "summary", "content")
            .join(labels, "doc_id", "left")
            .groupBy("topic_id")
            .agg(
                F.sum("n_chars").alias("input_tokens"),
                F.max("toxic").alias("toxic"),
                F.min_by("summary", "doc_id").alias("lead"),
                F.min_by("content", "doc_id").alias("body"),
            )
        )
        t = F.col("topic_id")
        toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
        hours = lambda h: F.col("first_added_at") + F.make_interval(hours=h)
        articles = passing.join(material, "topic_id").select(
            t.alias("article_id"),
            "topic_id",
            hours(F.lit(1)).alias("created_at"),
            F.when(t % 2 == 1, "flagship").otherwise("default").alias("model"),
            "input_tokens",
            (F.lit(1200) + t % 500).alias("output_tokens"),
            F.when(t % 7 == 0, 4096).alias("cache_creation_tokens"),
            F.when(t % 7 != 0, 4096).alias("cache_read_tokens"),
            F.when(t % 5 != 0, hours((2 + t % 4).cast("int"))).alias("last_update_at"),
            (1 + t % 7).alias("revision"),
            F.col("title_sample").alias("title"),
            "lead",
            "body",
            toxic.alias("sensitive"),
            F.when(t % 6 != 0, F.concat(F.lit("covers/"), t, F.lit(".png"))).alias("cover_url"),
            F.when(t % 4 != 0, F.col("first_added_at") + F.expr("INTERVAL 150 MINUTES")).alias(
                "cover_at"
            ),
            F.when(t % 16 == 0, "rejected")
            .when(toxic, "pending_review")
            .otherwise("published")
            .alias("status"),
            F.element_at(
                F.array(*[F.lit(c) for c in scoring.P.CATEGORIES]), (t % 6 + 1).cast("int")
            ).alias("category"),
        )
        return materialize(articles, "articles")

    @cached_property
    def costed(self) -> DataFrame:
        return scoring.call_cost(self.articles)

    @cached_property
    def topics(self) -> DataFrame:
        covered = self.articles.select("topic_id", "article_id")
        return (
            self.scored.join(covered, "topic_id", "left")
            .withColumn("needs_flagship", F.col("topic_id") % 13 == 0)
            .withColumn(
                "status",
                F.when(F.col("article_id").isNotNull(), "covered")
                .when((F.col("size") == 1) & (F.col("topic_id") % 19 == 0), "rejected")
                .otherwise("open"),
            )
        )

    @cached_property
    def attempts(self) -> DataFrame:
        return self.events.select(
            "event_id",
            F.col("user_id").alias("source_id"),
            (F.col("event_type") != "error").alias("ok"),
            "ts",
        )

    @cached_property
    def decisions(self) -> DataFrame:
        user = F.col("user_id")
        kind = F.col("event_type")
        return self.events.select(
            "event_id",
            user.alias("article_id"),
            "ts",
            F.when(kind == "purchase", F.concat(F.lit("odobri:"), user))
            .when(kind == "error", F.concat(F.lit("odbij:"), user))
            .otherwise(F.concat(kind, F.lit(":"), user))
            .alias("payload"),
            F.when(kind == "signup", "other").otherwise("desk").alias("chat_id"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        return self.events.groupBy(F.col("user_id").alias("article_id")).agg(
            (
                F.min("ts")
                + F.expr("INTERVAL 14 DAYS")
                + F.make_interval(hours=(F.col("user_id") % 5).cast("int"))
            ).alias("sent_at")
        )

    @cached_property
    def fetches(self) -> DataFrame:
        return self.events.select(
            "event_id",
            F.concat(F.lit("https://site"), F.col("user_id"), F.lit(".example/feed")).alias("url"),
            "ts",
            F.floor(F.col("value") / 25).alias("etag"),
        )

    @cached_property
    def crawl(self) -> DataFrame:
        p = F.col("page_id")
        return self.table("pages").select(
            "page_id",
            "url",
            U.host(F.col("url")).alias("host"),
            F.when(p % 9 == 7, "blocked").when(p % 9 == 8, "error").when(p % 9 == 3, "missing")
            .otherwise("ok").alias("robots_state"),
            F.when(p % 4 == 0, 200).when(p % 4 == 1, 403).when(p % 4 == 2, 404).otherwise(503)
            .alias("homepage_status"),
            F.when(p % 5 == 0, p % 9).otherwise(0).alias("feed_items"),
            F.when(p % 3 == 0, p % 4).otherwise(0).alias("news_entries"),
        )

    @cached_property
    def batches(self) -> DataFrame:
        t = F.col("topic_id")
        return self.articles.select(
            "topic_id",
            (t % 10).alias("batch_id"),
            F.concat(F.lit("tema-"), t).alias("custom_id"),
            "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens",
            F.when(t % 8 == 1, "errored").when(t % 8 == 2, "expired").when(t % 8 == 3, "canceled")
            .otherwise("succeeded").alias("result_type"),
            F.when(t % 16 == 1, "invalid_request").otherwise("overloaded").alias("error_type"),
            (t % 8 != 5).alias("schema_ok"),
            (t % 10 < 5).alias("submitted"),
        )
