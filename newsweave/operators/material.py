"""Prompt material, request batches, response repair and review messages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave import params as P, schemas
from newsweave.functions import text as X, times as T
from newsweave.functions.core import let
from newsweave.operators import scoring

NL = "\n"


def _lines(*parts: Column) -> Column:
    """Lines of a message; a null part leaves no line."""
    return F.concat_ws(NL, *parts)


# --- prompt material -------------------------------------------------------------------------


def topic_sources(members: DataFrame, limit: int = P.PROMPT_SOURCES) -> DataFrame:
    """The wordiest reports of each topic; the rank filter trims topics inside the tasks."""
    order = Window.partitionBy("topic_id").orderBy(F.desc("word_count"), "doc_id")
    return members.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def report_text(update: bool = False) -> Column:
    """One report of the material, labelled by viewpoint and never by publisher."""
    labels = F.create_map(*[F.lit(v) for pair in P.ANGLE_LABELS.items() for v in pair])
    heading = "Novi izveštaj" if update else "Izveštaj"
    raw = F.coalesce("content", "summary", F.lit(""))
    body = F.left(X.collapse_whitespace(raw), F.lit(P.PROMPT_SOURCE_CHARS))
    return _lines(
        F.concat(F.lit(f"## {heading} "), F.col("rank"), F.lit(" — "), labels[F.col("angle")]),
        F.concat(F.lit("Objavljeno: "), F.date_format("item_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
        F.lit(""),
        F.concat(F.lit("Naslov: "), X.collapse_whitespace(F.col("title"))),
        F.when(raw != "", F.lit("")),
        F.when(raw != "", body),
        F.lit(""),
    )


def prompt_messages(topics: DataFrame, members: DataFrame, articles: DataFrame | None = None):
    """Topics(topic_id, title_sample, keywords, entities) and member rows to one message each.

    At most eight reports are collected per topic. With ``articles`` (title,
    lead, body, revision) the message asks to extend the existing article.
    """
    update = articles is not None
    chosen = topic_sources(members).select(
        "topic_id", F.struct("rank", report_text(update).alias("text")).alias("report")
    )
    reports = chosen.groupBy("topic_id").agg(F.array_sort(F.collect_list("report")).alias("reports"))
    counts = members.groupBy("topic_id").agg(F.count("*").alias("n_reports"))
    joined = topics.join(reports, "topic_id").join(counts, "topic_id")
    if update:
        joined = joined.join(
            articles.select(
                "topic_id", F.col("title").alias("a_title"), "lead", "body", "revision"
            ),
            "topic_id",
        )
        head = "# Dopuna već objavljenog članka"
        intro = _lines(
            F.concat(F.lit("## Članak koji se dopunjuje (verzija "), F.col("revision"), F.lit(")")),
            F.lit(""),
            F.concat(F.lit("Naslov: "), F.col("a_title")),
            F.lit(""),
            F.concat(F.lit("Uvod: "), F.col("lead")),
            F.lit(""),
            F.col("body"),
            F.lit(""),
            F.concat(
                F.lit("Sledi "), F.col("n_reports"),
                F.lit(
                    " NOVIH izveštaja koji su stigli posle te verzije. Ugradi ono što je stvarno "
                    "novo, po pravilima za dopunu. Vrati ceo članak, ne samo izmene."
                ),
            ),
        )
    else:
        head = "# Materijal za jedan članak"
        intro = F.concat(
            F.lit("Sledi "), F.col("n_reports"),
            F.lit(
                " nezavisnih izveštaja o istom događaju. Označeni su uglom iz kog izveštavaju. "
                "Napiši jedan članak po uredničkim pravilima."
            ),
        )
    listed = lambda label, c: F.when(
        F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(c, 1, 10), ", "))
    )
    message = _lines(
        F.lit(head),
        F.lit(""),
        F.concat(F.lit("Tema: "), F.col("title_sample")),
        listed("Ključne reči iz izveštaja: ", F.col("keywords")),
        listed("Imena i nazivi koji se pominju: ", F.col("entities")),
        F.lit(""),
        intro,
        F.lit(""),
        F.array_join(F.transform("reports", lambda r: r["text"]), NL),
    )
    trimmed = F.regexp_replace(message, f"^{X.WS}+|{X.WS}+$", "")
    return joined.select("topic_id", "n_reports", trimmed.alias("message"))


def request_batches(requests: DataFrame, per_batch: int) -> DataFrame:
    """Requests(topic_id, custom_id, model) to batches of one model each.

    A model with many requests gets as many batches as keep them near
    ``per_batch``, so no batch row grows with the data. Batches are dealt by a
    hash of the request's id, whatever pattern the ids have.
    """
    sizes = requests.groupBy("model").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / per_batch)).alias("n_batches")
    )
    return (
        requests.join(sizes, "model")
        .withColumn("batch_no", F.pmod(F.conv(F.left(F.md5("custom_id"), F.lit(8)), 16, 10).cast("bigint"), F.col("n_batches")))
        .groupBy("model", "batch_no")
        .agg(
            F.count("*").alias("request_count"),
            F.map_from_entries(F.collect_list(F.struct("custom_id", "topic_id"))).alias("topic_map"),
        )
    )


def topics_in_flight(batches: DataFrame) -> DataFrame:
    """Topic ids inside the maps of submitted batches."""
    return batches.filter("status = 'submitted'").select(
        F.explode(F.map_values("topic_map")).alias("topic_id")
    )


def responses_with_topic(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """Join responses(batch_id, custom_id, ...) to their topic through the batch's map."""
    mapping = batches.select("batch_id", F.explode("topic_map").alias("custom_id", "topic_id"))
    return responses.join(mapping, ["batch_id", "custom_id"])


def route_outcomes(responses: DataFrame) -> DataFrame:
    """Add succeeded, reason and retryable to responses(result_type, error_type, schema_ok)."""
    kind = F.col("result_type")
    reason = (
        F.when(kind == "errored", F.concat(F.lit("greška u obradi ("), F.col("error_type"), F.lit(")")))
        .when(kind == "expired", "zahtev je istekao")
        .when(kind != "succeeded", "neočekivan ishod")
        .when(~F.col("schema_ok"), "odgovor ne odgovara šemi")
    )
    # A malformed request fails again; everything else may work next time.
    hopeless = (kind == "errored") & (F.col("error_type") == "invalid_request")
    return responses.withColumn("reason", reason).withColumns(
        {
            "succeeded": F.col("reason").isNull(),
            "retryable": F.col("reason").isNotNull() & ~hopeless,
        }
    )


def batch_results(responses: DataFrame) -> DataFrame:
    """Per batch: succeeded, failed, retryable and the half-price cost of what succeeded."""
    costed = scoring.call_cost(route_outcomes(responses), batch=True)
    return costed.groupBy("batch_id", "model").agg(
        F.count_if("succeeded").alias("n_succeeded"),
        F.count_if(~F.col("succeeded")).alias("n_failed"),
        F.count_if("retryable").alias("n_retryable"),
        F.sum(F.when(F.col("succeeded"), F.col("total_cost")).otherwise(F.lit(0))).alias("cost_usd"),
    )


# --- responses -------------------------------------------------------------------------------------


def repair_responses(responses: DataFrame) -> DataFrame:
    """Responses(body JSON in ``raw``) to repaired article fields, repairs[] and problems[].

    Only what is unambiguous is repaired; ``problems`` says what stays wrong.
    """
    parsed = responses.withColumn("r", F.from_json("raw", schemas.RESPONSE))
    present = F.col("r").isNotNull() & F.ltrim("raw").startswith("{")
    category = X.normalize_category(F.col("r.category"))
    staged = parsed.withColumns(
        {
            "present": present,
            "category": category,
            "body": X.merge_paragraphs(F.col("r.body")),
        }
    )
    none = F.array().cast("array<string>")
    translated = ~X.collapse_whitespace(X.match_key(F.col("r.category"))).isin(*P.CATEGORIES)
    empty_sides = F.get_json_object("raw", "$.bothSides") == "{}"
    note = lambda happened, text: F.when(happened, text)
    merged = F.size("r.body") - F.size("body")
    repairs = F.array(
        note(
            F.col("category") != F.col("r.category"),
            F.concat(
                F.lit("kategorija „"), F.col("r.category"),
                F.when(translated, '" prevedena u „').otherwise('" svedena na „'),
                F.col("category"), F.lit('"'),
            ),
        ),
        note(merged > 0, F.concat(F.lit("spojeno "), merged, F.lit(" prekratkih pasusa"))),
        note(
            F.col("r.sensitivityReason") == "",
            F.lit("prazno obrazloženje osetljivosti pretvoreno u null"),
        ),
        note(empty_sides, F.lit("prazan prikaz „obe strane\" pretvoren u null")),
        note(F.col("r.keywords").isNull(), F.lit("polje keywords je izostalo, upisan prazan niz")),
        note(F.col("r.notes").isNull(), F.lit("polje notes je izostalo, upisan prazan niz")),
    )
    raw = F.try_parse_json("raw")

    def typed(name: str, kind: str, nullable: bool = False) -> Column:
        """Absent, or there with another JSON type: from_json reads numbers as text without a word."""
        value = F.schema_of_variant(F.try_variant_get(raw, f"$.{name}", "variant"))
        fine = value.rlike(rf"^({kind})$")
        if nullable:
            fine = value.isNull() | (value == "VOID") | fine
        absent = value.isNull() | (value == "VOID")
        return F.when(~F.coalesce(fine, F.lit(False)), F.when(absent, f"{name}: izostaje").otherwise(f"{name}: pogrešan tip"))

    panels = F.col("r.bothSides")
    sides = ("officialLabel", "officialText", "criticalLabel", "criticalText")
    has_sides = panels.isNotNull() & ~F.coalesce(empty_sides, F.lit(False))
    n_parts = F.coalesce(F.size("body"), F.lit(0))
    short = F.transform(
        F.coalesce("body", none),
        lambda p, i: F.when(
            F.length(p) < P.MIN_PARAGRAPH_CHARS, F.concat(F.lit("body."), i, F.lit(": prekratak pasus"))
        ),
    )
    checks = F.concat(
        F.array(
            *[typed(n, "STRING") for n in ("title", "lead")],
            *[typed(n, "BOOLEAN") for n in ("sensitive", "sourcesDiverge")],
            typed("sensitivityReason", "STRING", nullable=True),
            *[typed(n, r"ARRAY<(STRING|VOID)>", nullable=True) for n in ("body", "keywords", "notes")],
            *[F.when(has_sides & panels[n].isNull(), F.lit(f"bothSides.{n}: izostaje")) for n in sides],
            F.when(
                ~F.coalesce(F.col("category").isin(*P.CATEGORIES), F.lit(False)),
                F.lit("category: van spiska"),
            ),
            F.when(n_parts < P.MIN_PARAGRAPHS, F.lit("body: premalo pasusa")),
            F.when(n_parts > P.MAX_PARAGRAPHS, F.lit("body: previše pasusa")),
        ),
        short,
    )
    said = lambda notes: F.filter(notes, lambda n: n.isNotNull())
    return staged.select(
        *responses.columns,
        F.col("r.title").alias("title"),
        F.col("r.lead").alias("lead"),
        "body",
        "category",
        F.coalesce("r.sensitive", F.lit(False)).alias("sensitive"),
        F.nullif(F.col("r.sensitivityReason"), F.lit("")).alias("sensitivity_reason"),
        F.when(~F.coalesce(empty_sides, F.lit(False)), F.col("r.bothSides")).alias("both_sides"),
        F.coalesce("r.keywords", none).alias("keywords"),
        F.coalesce("r.notes", none).alias("notes"),
        F.when(F.col("present"), said(repairs)).otherwise(none).alias("repairs"),
        F.when(F.col("present"), said(checks))
        .otherwise(F.array(F.lit("odgovor nije objekat")))
        .alias("problems"),
    )


def article_rows(responses: DataFrame, now: Column) -> DataFrame:
    """Article rows from accepted responses; sensitive ones wait for a person."""
    return responses.select(
        "topic_id",
        X.slugify(F.col("title"), now).alias("slug"),
        "title",
        "lead",
        "body",
        "category",
        "sensitive",
        F.when(F.col("sensitive"), "pending_review").otherwise("draft").alias("status"),
        scoring.article_words().alias("word_count"),
        "model",
        F.lit(1).alias("revision"),
    )


# --- review messages ----------------------------------------------------------------------------------

# --- fixed values: texts of the review messages; those of prompts and repairs stand where they are used ---
REVIEW_HEAD = "⚠️ <b>Osetljiv članak — čeka odobrenje</b>"
REVIEW_NOTE = (
    "<i>Dugme će se nakratko vrteti — to je normalno. Odluka se upisuje kad pipeline "
    "sledeći put pokupi odgovore. Dovoljno je pritisnuti jednom.</i>"
)
DECIDED_HEADS = {
    "approved": "✅ <b>Odobreno i objavljeno</b>",
    "rejected": "❌ <b>Odbijeno — ostaje neobjavljeno</b>",
    "expired": "⏳ <b>Isteklo bez odgovora — ostaje kao nacrt</b>",
}


def review_message(max_chars: int = P.MAX_MESSAGE_CHARS) -> Column:
    """Message to the desk: what the article says and why a person must decide."""
    bold_title = F.concat(F.lit("<b>"), X.escape_html(F.col("title")), F.lit("</b>"))
    opening = _lines(
        F.lit(REVIEW_HEAD), F.lit(""), bold_title, F.lit(""), X.escape_html(F.col("lead")), F.lit("")
    )
    sources = F.when(
        F.col("source_count") > 0, F.concat(F.lit(" · izvora: "), F.col("source_count"))
    )
    facts = F.concat(
        F.lit("Rubrika: "), F.col("category"), F.lit(" · "), F.col("word_count"),
        F.lit(" reči · model: "), F.col("model"), F.coalesce(sources, F.lit("")),
    )
    reason = X.escape_html(F.coalesce("sensitivity_reason", F.lit("nije naveden")))

    def whole(head: Column) -> Column:
        room = F.greatest(F.lit(300), F.lit(max_chars) - F.length(head))
        return _lines(
            head,
            X.escape_html(X.trim_to_length(F.col("body"), room)),
            F.lit(""),
            F.lit("———"),
            F.concat(F.lit("Razlog: "), reason),
            facts,
            F.lit(""),
            F.lit(REVIEW_NOTE),
        )

    return let(opening, whole)


def decided_message(zone: str = P.ZONE) -> Column:
    """Text that replaces the message once decision and decided_at are known."""
    heads = F.create_map(*[F.lit(v) for pair in DECIDED_HEADS.items() for v in pair])
    local = F.from_utc_timestamp("decided_at", zone)
    return _lines(
        heads[F.col("decision")],
        F.lit(""),
        F.concat(F.lit("<b>"), X.escape_html(F.col("title")), F.lit("</b>")),
        F.lit(""),
        X.escape_html(F.col("lead")),
        F.lit(""),
        F.lit("———"),
        F.concat(
            F.date_format(local, "d. M. yyyy. HH:mm:ss"), F.lit(" · rubrika: "), F.col("category"),
            F.lit(" · "), F.col("word_count"), F.lit(" reči"),
        ),
    )


def publish_label(column: str = "published_at") -> Column:
    return T.date_label(F.col(column))
