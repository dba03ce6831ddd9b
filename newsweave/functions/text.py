"""Text normalisation, tokens, named entities and titles as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, functions as F

from newsweave import params as P
from newsweave.functions.core import let

# Whitespace as browsers and feed readers see it; Java's own \s leaves out the
# no-break space and the typographic spaces.
WS = (
    r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)


def _where(text: Column, letters: str, change) -> Column:
    """``change(text)`` where the text has one of the letters; a translation that finds none costs as much as one that does."""
    return let(text, lambda t: F.when(t.rlike(f"[{letters}]"), change(t)).otherwise(t))


def to_latin(text: Column) -> Column:
    """Serbian Cyrillic to Latin; Latin text passes through unchanged."""

    def change(t: Column) -> Column:
        for cyrillic, latin in P.CYRILLIC_DIGRAPHS:
            t = F.replace(t, F.lit(cyrillic), F.lit(latin))
        return F.translate(t, P.CYRILLIC_SINGLE, P.LATIN_SINGLE)

    return _where(text, r"\x{400}-\x{4FF}", change)


def fold_diacritics(text: Column) -> Column:
    def change(t: Column) -> Column:
        for letter, ascii_form in P.DIACRITIC_DIGRAPHS:
            t = F.replace(t, F.lit(letter), F.lit(ascii_form))
        return F.translate(t, P.DIACRITIC_SINGLE, P.ASCII_SINGLE)

    return _where(text, r"\x{106}-\x{17E}", change)


def match_key(text: Column) -> Column:
    """Form used for comparing: Latin script, no diacritics, lower case."""
    return F.lower(fold_diacritics(to_latin(text)))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def count_words(text: Column) -> Column:
    return let(
        collapse_whitespace(F.coalesce(text, F.lit(""))),
        lambda clean: F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, " "))),
    )


def strip_html(markup: Column) -> Column:
    """Readable text of a snippet: scripts, styles and tags out, basic entities decoded."""
    text = F.regexp_replace(markup, r"(?is)<script.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style.*?</style>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, char in (
        ("&nbsp;", " "),
        ("&amp;", "&"),
        ("&quot;", '"'),
        ("&#39;|&apos;", "'"),
        ("&lt;", "<"),
        ("&gt;", ">"),
    ):
        text = F.regexp_replace(text, "(?i)" + entity, char)
    return collapse_whitespace(text)


def content_fingerprint(title: Column, text: Column) -> Column:
    """Equal for texts that differ only in spacing, punctuation or case."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(F.lower(collapse_whitespace(joined)), r"[^\p{L}\p{N} ]", "")
    return F.sha2(bare, 256)


# --- tokens -----------------------------------------------------------------------


def stem(word: Column, vp: P.VectorParams = P.VectorParams()) -> Column:
    """Strip the longest listed ending that leaves at least ``min_stem`` characters."""
    endings = sorted(vp.suffixes, key=len, reverse=True)
    stripped = F.regexp_replace(word, f"^(.{{{vp.min_stem},}}?)({'|'.join(endings)})$", "$1")
    # Words that end in a letter no ending has never see the pattern.
    return F.when(F.substring(word, -1, 1).isin(*sorted({e[-1] for e in endings})), stripped).otherwise(word)


def words(text: Column) -> Column:
    return F.split(text, r"[^\p{L}\p{N}]+")


def _meaningful(vp: P.VectorParams):
    def keep(piece: Column) -> Column:
        short_number = (F.length(piece) < 4) & piece.rlike("^[0-9]+$")
        return (F.length(piece) >= vp.min_word) & ~piece.isin(*vp.stop_words) & ~short_number

    return keep


def tokens(text: Column, vp: P.VectorParams = P.VectorParams()) -> Column:
    """All stems of a text, for comparing."""
    pieces = F.filter(F.split(match_key(text), "[^a-z0-9]+"), _meaningful(vp))
    return F.transform(pieces, lambda piece: stem(piece, vp))


def first_piece(folded_word: Column, vp: P.VectorParams = P.VectorParams()) -> Column:
    """Array with the part that stands for one already folded word, empty when it has no topic."""
    plain = folded_word.rlike("^[a-z0-9]*$")
    pieces = F.when(plain, F.array(folded_word)).otherwise(F.split(folded_word, "[^a-z0-9]+"))
    return F.slice(F.filter(pieces, _meaningful(vp)), 1, 1)


def word_terms(vp: P.VectorParams = P.VectorParams()):
    """``first_piece`` and ``stem`` of one folded word as a plain function, None where it has no topic."""
    stop, pieces = frozenset(vp.stop_words), re.compile("[a-z0-9]+")
    endings = frozenset(vp.suffixes)
    sizes = sorted({len(e) for e in endings}, reverse=True)

    @lru_cache(1 << 18)
    def term(word: str) -> str | None:
        for piece in pieces.findall(word):
            if len(piece) >= vp.min_word and piece not in stop and not (len(piece) < 4 and piece.isdigit()):
                for n in sizes:
                    if piece[-n:] in endings and len(piece) - n >= vp.min_stem:
                        return piece[:-n]
                return piece
        return None

    return term


# --- named entities ----------------------------------------------------------------

_BREAK = "\u0001"


def entity_runs(text: Column, vp: P.VectorParams = P.VectorParams()) -> Column:
    """Every run of capitalised words that does not open its sentence, in text order.

    Each sentence becomes an array of words in which all other words are
    replaced by a break mark; joining and splitting on the mark yields the
    runs inside the row, without a shuffle.
    """

    def mark(word: Column, index: Column) -> Column:
        bare = F.regexp_replace(word, r"^[^\p{L}]+|[^\p{L}]+$", "")
        # Most words have no capital, which costs least to see.
        inside = (index > 0) & word.rlike(r"\p{Lu}") & bare.rlike(r"^\p{Lu}\p{L}{2,}")
        return F.when(inside, bare).otherwise(F.lit(_BREAK))

    def mark_words(s: Column) -> Column:
        words = F.transform(F.split(collapse_whitespace(s), " "), mark)
        return F.array_join(F.concat(words, F.array(F.lit(_BREAK))), " ")

    sentences = F.split(to_latin(text), rf"(?<=[.!?]){WS}+|\n+")
    # Without a capital after its first letter a sentence is breaks only, and one says as much.
    marked = F.transform(
        sentences, lambda s: F.when(s.rlike(r"(?s).\p{Lu}"), mark_words(s)).otherwise(F.lit(_BREAK))
    )
    runs = F.split(F.array_join(marked, " "), f" ?{_BREAK} ?")
    runs = F.transform(runs, lambda r: F.trim(r))
    names = lambda key: (F.length(key) >= 4) & ~key.isin(*vp.stop_words)
    return F.filter(runs, lambda r: let(match_key(r), names))


def entity_counts(runs: Column) -> Column:
    """Array of (n, entity), most frequent first, name breaking ties."""

    def count(found: Column) -> Column:
        return F.transform(
            F.array_distinct(found),
            lambda e: F.struct(
                (-F.size(F.filter(found, lambda r: r == e))).alias("neg_n"), e.alias("entity")
            ),
        )

    return F.transform(
        F.array_sort(let(runs, count)),
        lambda s: F.struct((-s["neg_n"]).alias("n"), s["entity"].alias("entity")),
    )


def entities(text: Column, limit: int | None = None, vp: P.VectorParams = P.VectorParams()) -> Column:
    """Names by frequency; all of them unless a limit is given."""
    ranked = entity_counts(entity_runs(text, vp))
    return F.transform(ranked if limit is None else F.slice(ranked, 1, limit), lambda s: s["entity"])


# --- titles and bodies ----------------------------------------------------------------


def is_multi_event(title: Column) -> Column:
    """Round-up title: two or more statements joined by semicolons."""
    several = lambda parts: (F.size(parts) > 1) & F.forall(
        parts, lambda p: F.size(F.split(p, " ")) >= 4
    )
    return let(F.transform(F.split(title, ";"), collapse_whitespace), several)


def is_live_blog(title: Column) -> Column:
    return match_key(title).rlike(
        r"(^|[^a-z0-9_])(uzivo|blog|live)([^a-z0-9_]|$)|minut po minut|sta se desava"
    )


def unsuitable_as_topic_title(title: Column) -> Column:
    return is_multi_event(title) | is_live_blog(title)


def clean_title(title: Column) -> Column:
    """Drop up to three trailing section or publisher names, keeping 20 characters."""

    def cut_tail(current: Column) -> Column:
        shorter = F.regexp_replace(current, r" +[|—–-] +[^|—–-]{2,40}$", "")
        return let(shorter, lambda s: F.when(F.length(s) >= 20, s).otherwise(current))

    current = collapse_whitespace(title)
    for _ in range(3):
        current = let(current, cut_tail)
    return let(current, lambda t: F.when(t != "", t))


def clean_body(raw: Column) -> Column:
    """Drop a breadcrumb trail at the start and a leading comment counter."""

    def after_trail(text: Column) -> Column:
        from_end = F.instr(F.reverse(F.left(text, F.lit(250))), "»")
        start = F.least(F.lit(250), F.length(text)) - from_end + 2
        rest = F.ltrim(F.substring(text, start, F.length(text)))
        return F.when(from_end > 0, rest).otherwise(text)

    text = let(collapse_whitespace(F.coalesce(raw, F.lit(""))), after_trail)
    counter = r"(?i)^[0-9]+ +komentar[ai]?([^a-z0-9_][ :.-]*|$)"
    return F.trim(F.regexp_replace(text, counter, ""))


# Accented Latin letters and their base letters (fixed values).
ACCENTED = "áàâäãåāăąćčçďéèêëēėęěíìîïīįłĺľńñňóòôöõōőŕřśšşţťúùûüūůűýÿźžż"
BASE = "aaaaaaaaacccdeeeeeeeeiiiiiilllnnnooooooorrsssttuuuuuuuyyzzz"


def slugify(title: Column, day: Column) -> Column:
    lowered = F.lower(title)
    folded = F.translate(F.replace(lowered, F.lit("đ"), F.lit("dj")), ACCENTED, BASE)
    base = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    base = F.regexp_replace(F.left(base, F.lit(70)), "-+$", "")
    named = F.regexp_replace(base, "^$", "clanak")
    return F.concat_ws("-", named, F.date_format(day, "yyyy-MM-dd"))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


# --- fixed value: what a shortened message ends with ---
TRIM_NOTE = "\n\n[…tekst je skraćen za poruku; ceo je u bazi]"


def trim_to_length(text: Column, limit: Column) -> Column:
    """Cut at the last sentence end past half of the limit and say so."""

    def whole_sentences(cut: Column) -> Column:
        stop = F.length(F.regexp_extract(cut, r"(?s)^(.*[.])[ \n]", 1))
        return F.when(stop - 1 > limit * 0.5, F.left(cut, stop)).otherwise(cut)

    kept = let(F.left(text, limit), whole_sentences)
    shortened = F.concat(F.regexp_replace(kept, WS + "+$", ""), F.lit(TRIM_NOTE))
    return F.when(F.length(text) <= limit, text).otherwise(shortened)


def fit_title(title: Column, limit: int = 150) -> Column:
    """Cut a long title at a word boundary past 60 % of the limit."""

    def fit(clean: Column) -> Column:
        cut = F.left(clean, F.lit(limit))
        head = F.regexp_extract(cut, "^(.*) ", 1)
        kept = F.when(F.length(head) > limit * 0.6, head).otherwise(cut)
        shortened = F.concat(F.regexp_replace(kept, "[,.;:–-]$", ""), F.lit("…"))
        return F.when(F.length(clean) <= limit, clean).otherwise(shortened)

    return let(collapse_whitespace(title), fit)


def stable_bucket(key: Column, buckets: int = 3) -> Column:
    """32-bit FNV-1a of the key, modulo ``buckets``; equal on every machine and engine."""
    codes = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c))
    hashed = F.aggregate(
        codes,
        F.lit(0x811C9DC5).cast("bigint"),
        lambda acc, code: F.pmod(
            acc.bitwiseXOR(code.cast("bigint")) * F.lit(0x01000193), F.lit(0x100000000)
        ),
    )
    return F.pmod(hashed, F.lit(buckets))


def normalize_category(raw: Column, synonyms: dict[str, str] = P.CATEGORY_SYNONYMS) -> Column:
    """Official category, or the one a known synonym stands for, else the raw value."""
    table = F.create_map(*[F.lit(v) for pair in synonyms.items() for v in pair])

    def official(key: Column) -> Column:
        mapped = F.coalesce(table[key], table[F.get(F.split(key, "[ ,/]"), F.lit(0))])
        return F.when(key.isin(*P.CATEGORIES), key).otherwise(F.coalesce(mapped, raw))

    return let(collapse_whitespace(match_key(raw)), official)


def merge_paragraphs(paragraphs: Column, min_chars: int = P.MIN_PARAGRAPH_CHARS) -> Column:
    """Join short paragraphs to the previous one, a short first one to the next."""
    clean = F.filter(
        F.transform(paragraphs, lambda p: F.regexp_replace(p, f"^{WS}+|{WS}+$", "")),
        lambda p: p != "",
    )

    def step(done: Column, text: Column) -> Column:
        glue = (F.length(text) < min_chars) & (F.size(done) > 0)
        last = F.concat_ws(" ", F.element_at(done, -1), text)
        return F.when(
            glue, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(last))
        ).otherwise(F.concat(done, F.array(text)))

    def join_head(merged: Column) -> Column:
        head = F.concat_ws(" ", F.get(merged, F.lit(0)), F.get(merged, F.lit(1)))
        rest = F.slice(merged, 3, F.greatest(F.size(merged) - 2, F.lit(0)))
        short_head = (F.size(merged) > 1) & (F.length(F.get(merged, F.lit(0))) < min_chars)
        return F.when(short_head, F.concat(F.array(head), rest)).otherwise(merged)

    return let(F.aggregate(clean, F.array().cast("array<string>"), step), join_head)


def paragraphs_to_text(paragraphs: Column) -> Column:
    return F.array_join(paragraphs, "\n\n")


def first_present(values: Sequence[Column]) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])
