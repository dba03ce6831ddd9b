"""Quality rules whose cut-offs are chosen under exact error bounds, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave.llm.common import SPACE_CLASS, SPACES, packed, same, whole_text, words
from newsweave.sinks import materialize

#: Share of good documents of a stratum that all rules together may reject, and the risk that they reject more.
ALPHA, DELTA = 0.05, 0.05
#: A cut-off is used only if it rejects labelled bad documents so many times as often as good ones.
LIFT = 3.0
#: A table of thresholds up to this many rows is broadcast.
MAX_BROADCAST = 10_000

#: Rule, what it measures (high is bad), cut-offs from lenient to strict.
RULES = [
    ("symbols", "n_symbols / greatest(word_chars, 1)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05]),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]),
    ("long_words", "word_chars / greatest(n_words, 1)", [40.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.0]),
    ("short_words", "-word_chars / greatest(n_words, 1)", [-1.5, -2.0, -2.5, -3.0]),
]


def _covered(starts: Column) -> Column:
    """Words covered by three-word windows that begin at these ascending places."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + s + 3 - F.greatest(acc["end"], s)).cast("int").alias("n"), (s + 3).cast("int").alias("end")
        ),
        lambda acc: acc["n"].cast("long"),
    )


def _repeated(windows: Column) -> Column:
    """Ascending places of windows whose hash occurs more than once in the array."""
    order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twin(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        return F.filter(
            sorted_windows,
            lambda x, j: ((j > 0) & (F.get(sorted_windows, j - 1)["h"] == x["h"]))
            | ((j < n - 1) & (F.get(sorted_windows, j + 1)["h"] == x["h"])),
        )

    twins = F.get(F.transform(F.array(order), twin), F.lit(0))
    return F.array_sort(F.transform(twins, lambda x: x["i"]))


def text_stats(frame: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of the column ``text``."""
    w, h = F.col("_words"), F.col("_windows")
    line_list = F.filter(F.split(F.col(text), "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    windows = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    return (
        frame.withColumn("_words", words(F.col(text)))
        .withColumn("_lines", line_list)
        .withColumn("_windows", windows)
        .withColumn("n_words", F.size(w).cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(text, SPACE_CLASS + "+", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn(
            "n_repeat_words",
            # Only texts with a repeat pay for the sort.
            F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(_repeated(h))),
        )
        .drop("_words", "_lines", "_windows")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact up to rounding, for 0 <= k <= n.

    The logarithm of the term at k is a sum of k logarithms; the lower terms follow by ratios.
    """
    odds = math.log(p) - math.log1p(-p)
    top = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        n * F.lit(math.log1p(-p)),
        lambda acc, j: acc + F.log((n - j + 1) / j) + F.lit(odds),
    )
    ratios = F.aggregate(
        F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, j: F.struct(
            (acc["sum"] + acc["term"] * j / (n - j + 1) * F.lit(math.exp(-odds))).alias("sum"),
            (acc["term"] * j / (n - j + 1) * F.lit(math.exp(-odds))).alias("term"),
        ),
        lambda acc: acc["sum"],
    )
    return F.least(F.lit(1.0), F.exp(top + F.log(ratios)))


def choose_thresholds(
    stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, lift: float = LIFT, rules=RULES
) -> DataFrame:
    """Per stratum and rule the strictest safe cut-off: stratum, rule, cutoff.

    Good labelled documents that pass the base rules are the holdout. For a cut-off that
    rejects k of n of them, the exact p-value of "more than alpha / rules are rejected" is a
    binomial tail. Within a stratum and rule cut-offs are tested from lenient to strict until
    one fails, which needs no correction; strata and rules share delta by Bonferroni. All
    labelled rows count; a document with clashing labels counts as bad.
    """
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality IS NOT NULL AND doc_id IS NOT NULL")
    held = stats.filter("NOT base_failed").join(marks, "doc_id").withColumn("good", F.col("quality") == 1)
    measures = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.expr(f"CAST({e} AS DOUBLE)").alias("value"), F.array(*map(F.lit, cuts)).alias("cuts"))
            for r, e, cuts in rules
        ]
    )
    measured = held.select("stratum", "good", F.explode(measures).alias("m"))
    tested = measured.select("stratum", "good", "m.rule", "m.value", F.posexplode("m.cuts").alias("step", "cutoff"))
    hit = F.col("value") > F.col("cutoff")
    counts = tested.groupBy("stratum", "rule", "step", "cutoff").agg(
        F.count_if("good").alias("n"),
        F.count_if(F.col("good") & hit).alias("k"),
        F.count_if(~F.col("good")).alias("n_bad"),
        F.count_if(~F.col("good") & hit).alias("k_bad"),
    )
    # In a struct null is counted as the stratum that it is.
    strata = F.greatest(F.count_distinct(F.struct("stratum")), F.lit(1))
    shares = counts.agg((F.lit(delta) / (strata * len(rules))).alias("level"))
    graded = counts.crossJoin(F.broadcast(shares)).withColumn("p", binomial_tail(F.col("k"), F.col("n"), alpha / len(rules)))
    in_order = Window.partitionBy("stratum", "rule").orderBy("step")
    safe = graded.withColumn("ok", F.min((F.col("p") <= F.col("level")) & (F.col("n") > 0)).over(in_order)).filter("ok")
    useful = safe.filter((F.col("k_bad") > 0) & (F.col("k_bad") * F.col("n") >= F.lit(lift) * F.col("k") * F.col("n_bad")))
    return useful.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def _verdict(frame: DataFrame, thresholds: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``kept``: not failed by the base rules and above no cut-off of its stratum."""
    wide = materialize(
        thresholds.groupBy("stratum").agg(
            *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_max_{r}") for r, _, _ in rules]
        ),
        "thresholds",
    )
    if wide.count() <= MAX_BROADCAST:
        wide = F.broadcast(wide)
    rejected = F.lit(False)
    for r, e, _ in rules:
        rejected = rejected | F.coalesce(F.expr(f"CAST({e} AS DOUBLE)") > F.col(f"_max_{r}"), F.lit(False))
    joined = frame.join(wide, same(frame, wide, "stratum"), "left").drop(wide["stratum"])
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected)


def _measured(docs: DataFrame, **more: Column) -> DataFrame:
    base = docs.select(*[c.alias(n) for n, c in more.items()], F.col("lang").alias("stratum"), whole_text().alias("text"))
    return text_stats(base).withColumn("base_failed", base_failed())


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): the statistics, base_failed and kept.

    The stratum is the language; null is a stratum of its own. A stratum without labelled
    documents, and an empty label table, leave only the base rules. Null texts have no words.
    """
    stats = materialize(_measured(docs, doc_id=F.col("doc_id")).drop("text"), "stats")
    return _verdict(stats, choose_thresholds(stats, labels, **options))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, all columns."""
    kept = quality_rules_rows(docs, labels, **options)
    return kept.filter("kept").select("row.*")


def quality_rules_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The whole rows beside their statistics and verdict; texts aren't shuffled."""
    tagged = packed(docs, doc_id=F.col("doc_id"), stratum=F.col("lang"), text=whole_text())
    stats = text_stats(tagged).withColumn("base_failed", base_failed())
    stored = materialize(stats.drop("text"), "measured")
    return _verdict(stored, choose_thresholds(stored.drop("row"), labels, **options))
