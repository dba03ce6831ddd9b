"""Schemas of the configuration files and of the stored tables."""

SOURCES_CONFIG = """
version INT,
defaults STRUCT<userAgent: STRING, requestsPerSecondPerDomain: DOUBLE, requestTimeoutMs: INT,
  respectRobotsTxt: BOOLEAN, maxConsecutiveFailures: INT, disableAfterFailuresHours: DOUBLE,
  maxItemsPerFetch: INT>,
sources ARRAY<STRUCT<id: STRING, name: STRING, homepage: STRING, angle: STRING, enabled: BOOLEAN,
  feeds: ARRAY<STRING>, newsSitemaps: ARRAY<STRING>,
  scrape: STRUCT<listingUrls: ARRAY<STRING>, itemLinkSelector: STRING, linkPattern: STRING,
    maxLinksPerRun: INT>,
  notes: STRING>>
"""

EDITORIAL_CONFIG = """
version INT,
cadence STRUCT<ingestEveryMinutes: INT, editorialEveryMinutes: INT, sweepCron: STRING>,
clustering STRUCT<similarityThreshold: DOUBLE, mergeThreshold: DOUBLE, windowHours: DOUBLE,
  minTitleChars: INT>,
gates STRUCT<minDistinctSources: INT, minDistinctAngles: INT, minTotalItems: INT,
  minWordsToPublish: INT, maxWordsToPublish: INT>,
updates STRUCT<existingArticleWindowHours: DOUBLE, minNewSourcesToTriggerUpdate: INT,
  maxUpdatesPerArticle: INT>,
limits STRUCT<maxArticlesPerDay: INT, maxFlagshipArticlesPerDay: INT,
  maxArticlesPerEditorialRun: INT, monthlyBudgetUsd: DOUBLE>,
models STRUCT<`default`: STRING, flagship: STRING, maxOutputTokens: INT>,
sensitivity STRUCT<topics: ARRAY<STRING>, approvalTimeoutHours: DOUBLE, onTimeout: STRING>,
retention STRUCT<rawItemsDays: INT, pipelineRunsDays: INT, rejectedClustersDays: INT>
"""

SOURCES = """
id STRING, name STRING, angle STRING, homepage STRING, enabled BOOLEAN,
consecutive_failures INT, disabled_until TIMESTAMP, last_error STRING, last_success_at TIMESTAMP
"""

RAW_ITEMS = """
id STRING, source_id STRING, url STRING, canonical_url STRING, url_hash STRING,
content_hash STRING, title STRING, summary STRING, content STRING, word_count INT,
author STRING, image_url STRING, language STRING, published_at TIMESTAMP,
fetched_at TIMESTAMP, extraction STRING
"""

FETCH_STATE = """
url STRING, source_id STRING, etag STRING, last_modified STRING, last_status INT,
last_fetched_at TIMESTAMP, last_changed_at TIMESTAMP
"""

TOPICS = """
id STRING, first_item_at TIMESTAMP, last_item_at TIMESTAMP, size INT, distinct_sources INT,
angles ARRAY<STRING>, keywords ARRAY<STRING>, entities ARRAY<STRING>,
centroid MAP<STRING, DOUBLE>, trending_score DOUBLE, title_sample STRING, status STRING,
article_id STRING, needs_flagship BOOLEAN
"""

TOPIC_ITEMS = "topic_id STRING, item_id STRING, similarity DOUBLE, added_at TIMESTAMP"

ARTICLES = """
id STRING, topic_id STRING, slug STRING, title STRING, lead STRING, body STRING,
category STRING, status STRING, sensitive BOOLEAN,
both_sides STRUCT<officialLabel: STRING, officialText: STRING, criticalLabel: STRING,
  criticalText: STRING>,
sources_diverge BOOLEAN, keywords ARRAY<STRING>, notes ARRAY<STRING>, word_count INT,
model STRING, usage MAP<STRING, BIGINT>, cost_usd DECIMAL(10,6), published_at TIMESTAMP,
revision INT, last_update_at TIMESTAMP, cover_url STRING, cover_at TIMESTAMP
"""

ARTICLE_REVISIONS = """
article_id STRING, revision INT, title STRING, lead STRING, body STRING, reason STRING,
model STRING, usage MAP<STRING, BIGINT>, cost_usd DECIMAL(10,6)
"""

BATCHES = """
batch_id STRING, model STRING, status STRING, request_count INT,
topic_map MAP<STRING, STRING>, succeeded INT, failed INT, cost_usd DECIMAL(10,6),
errors ARRAY<STRING>
"""

REVIEW_QUEUE = """
article_id STRING, chat_id STRING, message_id BIGINT, status STRING, sent_at TIMESTAMP,
decided_at TIMESTAMP, decided_by STRING, error STRING
"""

RUNS = """
command STRING, started_at TIMESTAMP, finished_at TIMESTAMP, ok BOOLEAN,
stats MAP<STRING, DOUBLE>, errors ARRAY<STRING>
"""

RESPONSE = """
title STRING, lead STRING, body ARRAY<STRING>, category STRING, sensitive BOOLEAN,
sensitivityReason STRING, sourcesDiverge BOOLEAN,
bothSides STRUCT<officialLabel: STRING, officialText: STRING, criticalLabel: STRING,
  criticalText: STRING>,
keywords ARRAY<STRING>, notes ARRAY<STRING>
"""
