"""Tunable parameters and fixed vocabularies of the engine.

Defaults are the published editorial rules; every operator takes them as an
argument, so a deployment overrides them without touching code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: enumerations -------------------------------------------------
ANGLES = ("provladin", "kriticki", "mejnstrim", "agencija")
DEFAULT_ANGLE = "mejnstrim"
CATEGORIES = ("politika", "ekonomija", "drustvo", "sport", "region", "svet")
TOPIC_STATUSES = ("open", "covered", "rejected")
ARTICLE_STATUSES = ("draft", "pending_review", "published", "rejected")
REVIEW_STATUSES = ("pending", "approved", "rejected", "expired", "failed")
EXTRACTION_METHODS = ("feed", "readability", "jsonld", "container", "none")

# --- fixed values: stop words (folded Latin script), connectives first, then
# --- newsroom phrases that occur in every story -----------------------------------
STOP_WORDS = tuple(
    """
    a ako ali bez bi bih bila bili bilo bio biti bice ce cemo ces cu da do dok dr
    ga god i iako ih ili im ima imaju imao iz ja je jedan jedna jedno jer jos ju
    kad kada kako kao koja koje koji kojih kojim kojoj koju kroz li me mi mogu moze
    my na nad nakon nas nasa ne nego nekoliko nema nesto ni nije nisu njega njegov
    njen nju no o od ona onda oni ono osim ova ovaj ove ovo pa po pod pored posle
    pre preko prema pri protiv sa sam samo se si smo ste su sve svi svoj ta taj tako
    te tim to toga tom tu u uz vec vise za zbog sto sta ko gde kome cega cemu jedne
    jednog
    izjavio izjavila rekao rekla kaze saopstio saopsteno navodi naveo dodao istakao
    poruka agencija portal redakcija foto video danas juce sutra godine godina sati
    sata casova prenosi objavljeno komentar komentara vest vesti tekst
    """.split()
)

# --- fixed values: inflection endings --------------------------------------------
SUFFIXES = tuple(
    """
    ovima evima ijama icama ovom evom ovim evim ama ima oga ome omu ovi evi iju ovo
    evo ova eva ovu evu ih im em om og ju a e i o u
    """.split()
)

# --- fixed values: Cyrillic to Latin ---------------------------------------------
CYRILLIC_SINGLE = "абвгдђежзијклмнопрстћуфхцчшАБВГДЂЕЖЗИЈКЛМНОПРСТЋУФХЦЧШ"
LATIN_SINGLE = "abvgdđežzijklmnoprstćufhcčšABVGDĐEŽZIJKLMNOPRSTĆUFHCČŠ"
CYRILLIC_DIGRAPHS = (("љ", "lj"), ("њ", "nj"), ("џ", "dž"), ("Љ", "Lj"), ("Њ", "Nj"), ("Џ", "Dž"))
DIACRITIC_SINGLE = "čćžšČĆŽŠ"
ASCII_SINGLE = "cczsCCZS"
DIACRITIC_DIGRAPHS = (("đ", "dj"), ("Đ", "Dj"))

# --- fixed values: month names ----------------------------------------------------
MONTHS = (
    "januar", "februar", "mart", "april", "maj", "jun",
    "jul", "avgust", "septembar", "oktobar", "novembar", "decembar",
)
ZONE = "Europe/Belgrade"

# --- fixed values: first path segments that are never a news section ----------------
IGNORED_SEGMENTS = (
    "tag", "tags", "author", "autor", "autori", "wp-content", "wp-json", "wp-admin",
    "static", "assets", "images", "img", "media", "user", "korisnik", "search",
    "pretraga", "login", "prijava", "newsletter", "kontakt", "impressum", "impresum",
)

# --- fixed values: category names accepted besides the official ones ---------------
CATEGORY_SYNONYMS = {
    "hronika": "drustvo",
    "crna_hronika": "drustvo",
    "crna hronika": "drustvo",
    "drustvo_hronika": "drustvo",
    "zdravstvo": "drustvo",
    "obrazovanje": "drustvo",
    "saobracaj": "drustvo",
    "vreme": "drustvo",
    "kultura": "drustvo",
    "zabava": "drustvo",
    "showbiz": "drustvo",
    "magazin": "drustvo",
    "tehnologija": "drustvo",
    "nauka": "drustvo",
    "biznis": "ekonomija",
    "privreda": "ekonomija",
    "finansije": "ekonomija",
    "balkan": "region",
    "srbija": "politika",
    "spoljna_politika": "politika",
    "svijet": "svet",
    "medjunarodno": "svet",
}

# --- fixed values: how a source is labelled in prompt material ---------------------
ANGLE_LABELS = {
    "provladin": "izvor blizak vlasti",
    "kriticki": "izvor kritičan prema vlasti",
    "mejnstrim": "mejnstrim izvor",
    "agencija": "novinska agencija",
}


@dataclass(frozen=True)
class VectorParams:
    title_weight: int = 3
    # Characters of the body that are scored; None reads it whole.
    body_chars: int | None = None
    min_word: int = 3
    min_stem: int = 4
    # Names kept of an item; None keeps all, which is what comparisons want.
    max_entities: int | None = None
    stop_words: tuple[str, ...] = STOP_WORDS
    suffixes: tuple[str, ...] = SUFFIXES


@dataclass(frozen=True)
class TopicParams:
    join_threshold: float = 0.38
    merge_threshold: float = 0.30
    entity_weight: float = 0.2
    window_hours: int = 36
    min_title_chars: int = 20
    centroid_terms: int = 120
    keywords: int = 8
    # Names of a topic that are shown; comparisons use all of them.
    topic_entities: int = 20


@dataclass(frozen=True)
class GateParams:
    min_sources: int = 3
    min_angles: int = 2
    min_items: int = 3
    min_words: int = 350


@dataclass(frozen=True)
class UpdateParams:
    window_hours: int = 6
    min_new_sources: int = 2
    max_revisions: int = 5


@dataclass(frozen=True)
class LimitParams:
    per_day: int = 10
    flagship_per_day: int = 3
    per_run: int = 5
    monthly_budget: float = 6.0


@dataclass(frozen=True)
class BreakerParams:
    max_failures: int = 3
    disable_hours: int = 6


@dataclass(frozen=True)
class RetentionParams:
    item_days: int = 10
    run_days: int = 30


@dataclass(frozen=True)
class PriceParams:
    """Dollars per million tokens (input, output) by model tier; unknown tiers use ``default``."""

    per_million: dict[str, tuple[int, int]] = field(
        default_factory=lambda: {"default": (1, 5), "flagship": (2, 10), "premium": (5, 25)}
    )
    cache_write: str = "1.25"
    cache_read: str = "0.1"


VELOCITY_HOURS = 6
FRESHNESS_HOURS = 12
REVIEW_TIMEOUT_HOURS = 2
MAX_MESSAGE_CHARS = 3500
PROMPT_SOURCES = 8
PROMPT_SOURCE_CHARS = 1600
ITEMS_PER_SOURCE = 25
FEEDS_PER_SOURCE = 5
MIN_ARTICLE_WORDS = 60
MIN_PARAGRAPHS = 4
MAX_PARAGRAPHS = 9
MIN_PARAGRAPH_CHARS = 200
