"""Secret scans over whole texts, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from newsweave.functions.core import let
from newsweave.llm.common import whole_text

#: Base kinds in their order: pattern, group whose length counts, least length.
#: The look-behinds only keep a run from being tried again from its middle.
BASE = [
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", 0, 16),
]
#: Strings whose entropy is measured, and the window.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Character class of a candidate, its pattern and the bits per character from which a window counts as random.
CLASSES = [
    ("digits", r"^[0-9]+$", 2.9),
    ("hexadecimal", r"^([0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("one_case_letters", r"^([a-z]+|[A-Z]+)$", 3.8),
    ("one_case", r"^([0-9a-z]+|[0-9A-Z]+)$", 3.6),
    ("letters", r"^[A-Za-z]+$", 3.9),
    ("mixed", r"^[A-Za-z0-9+/_=-]+$", 3.8),
]
_PART = r"(?:(?:[A-Z]?[a-z]++|[A-Z]++)[0-9]{0,4}|[0-9]{1,4})"
_PLACEHOLDER = "example|sample|placeholder|changeme|dummy"
#: Candidates that are never secrets: identifiers in a fixed layout, checksums that say so, words joined by
#: separators, names in camel case, numbers counted up, and placeholders: strings that begin or end with such
#: a word or are made of nothing else. Groups are possessive, so a very long string needs no stack.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(sha(1|256|384|512)|md5)[-_=]",
    rf"^[/_=+-]*+(?:{_PART}[/_=+-]++)++{_PART}?$",
    r"^[a-z]*+(?:[A-Z][a-z]++)++[0-9]{0,4}$",
    r"^0?(?:1234567890)*+[0-9]{0,9}$",
    rf"^(?i:{_PLACEHOLDER})|(?i:{_PLACEHOLDER})(?i:key)?$",
    rf"^(?i:{_PLACEHOLDER}|your|my|api|key|token|secret|test|here|x{{4,}}|0{{4,}}|1234567890|1234567|[/_=+-])++$",
]
#: Items of a slice of a scan.
SLICE = 256


def _scan(items: Column, state: Column, step: Callable[[Column, Column], Column], made: str) -> Column:
    """What ``step(state, item)``, a struct (state, made), makes of the items one after the other.

    An array that grows item by item would be copied for each; here only a slice's is, and the
    slices are put together at the end, so the work is linear in the items.
    """
    none = F.array().cast(f"array<{made}>")

    def over_slice(before: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(before.alias("state"), none.alias("out")),
            lambda acc, item: let(
                step(acc["state"], item),
                lambda r: F.struct(
                    r["state"].alias("state"), F.concat(acc["out"], F.array(r["made"])).cast(f"array<{made}>").alias("out")
                ),
            ),
        )

    def over_all(bound: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.floor((F.size(bound) - 1) / SLICE).cast("int")),
            F.struct(state.alias("state"), F.array().cast(f"array<array<{made}>>").alias("out")),
            lambda acc, k: let(
                over_slice(acc["state"], F.slice(bound, k * SLICE + 1, SLICE)),
                lambda r: F.struct(
                    r["state"].alias("state"),
                    F.concat(acc["out"], F.array(r["out"])).cast(f"array<array<{made}>>").alias("out"),
                ),
            ),
            lambda acc: F.flatten(acc["out"]),
        )

    return let(items, lambda bound: F.when(F.size(bound) > 0, over_all(bound)).otherwise(none))


MATCH = "struct<start:int,end:int,ok:boolean,string:string>"


def _matches(text: Column, pattern: str, group: int, least: int, strings: bool = False) -> Column:
    """Matches as (start, end, long enough, string if asked for), leftmost and not overlapping; offsets are code points.

    Splitting by the pattern gives the gaps between the matches, so their lengths give the places.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    sized = F.zip_with(
        found,
        measured,
        lambda m, part: F.struct(
            F.length(m).alias("size"), (F.length(part) >= least).alias("ok"), (m if strings else F.lit(None).cast("string")).alias("string")
        ),
    )
    # There is one gap more than there are matches.
    steps = F.filter(F.zip_with(sized, gaps, lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap"))), lambda s: s["m"].isNotNull())

    def step(at: Column, s: Column) -> Column:
        start, end = at + s["gap"], at + s["gap"] + s["m"]["size"]
        return F.struct(
            end.alias("state"),
            F.struct(start.alias("start"), end.alias("end"), s["m"]["ok"].alias("ok"), s["m"]["string"].alias("string")).alias("made"),
        )

    return F.when(F.rlike(text, F.lit(pattern)), _scan(steps, F.lit(0), step, MATCH)).otherwise(F.array().cast(f"array<{MATCH}>"))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of any window (79 characters at most) of the string.

    One walk over the characters. The counts of the window's characters are kept in a string, one
    place per character that occurs; the character that enters and the one that leaves change one
    place each, and with it the window's sum of n * log2(n). Strings shorter than a window give 0.
    """

    def weight(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def counted(alphabet: Column, state: Column, char: Column, by: int) -> Column:
        """State (counts, sum) after one character more or less; a count n is kept as the character 48 + n."""
        return let(
            F.instr(alphabet, char),
            lambda place: let(
                F.ascii(F.substr(state["counts"], place, F.lit(1))) - 48,
                lambda n: F.struct(
                    F.overlay(state["counts"], F.char(n + (48 + by)), place, F.lit(1)).alias("counts"),
                    (state["sum"] + weight(n + by) - weight(n)).alias("sum"),
                ),
            ),
        )

    def walk(chars: Column, alphabet: Column) -> Column:
        start = F.struct(F.repeat(F.lit("0"), F.length(alphabet)).alias("counts"), F.lit(0.0).alias("sum"))

        def step(acc: Column, i: Column) -> Column:
            left = F.when(i >= window, counted(alphabet, acc["state"], F.get(chars, i - window), -1)).otherwise(acc["state"])
            entered = let(left, lambda state: counted(alphabet, state, F.get(chars, i), 1))
            return let(
                entered,
                lambda state: F.struct(
                    state.alias("state"),
                    F.when(i >= window - 1, F.least(acc["low"], state["sum"])).otherwise(acc["low"]).alias("low"),
                ),
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.size(chars) - 1),
            F.struct(start.alias("state"), F.lit(math.inf).alias("low")),
            step,
            lambda acc: acc["low"],
        )

    low = let(F.split(text, ""), lambda chars: let(F.array_join(F.array_distinct(chars), ""), lambda alphabet: walk(chars, alphabet)))
    return F.when(F.length(text) >= window, F.lit(math.log2(window)) - low / window).otherwise(F.lit(0.0))


def _suspicious(text: Column) -> Column:
    """Whether a candidate string is as random as its character class asks and on no allow-list."""
    least = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        least = F.when(F.rlike(text, F.lit(pattern)), F.lit(bits)).otherwise(least)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.rlike(text, F.lit(pattern))
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(text) >= least)


RUN = "struct<start:int,run:boolean,end:int,string:string,touched:boolean>"


def _untouched(base: Column, runs: Column) -> Column:
    """The runs that no base match touches, by one walk over both in order and one back."""

    def items(spans: Column, run: bool) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(run).alias("run"), s["end"].alias("end"),
                (s["string"] if run else F.lit(None).cast("string")).alias("string"), F.lit(False).alias("touched"),
            ),
        ).cast(f"array<{RUN}>")

    def walk(edge: Callable[[Column, Column], Column], touches: Callable[[Column, Column], Column]):
        def step(state: Column, s: Column) -> Column:
            return F.struct(
                F.when(s["run"], state).otherwise(edge(state, s)).alias("state"),
                s.withField("touched", s["touched"] | (s["run"] & touches(state, s))).alias("made"),
            )

        return step

    merged = F.array_sort(F.concat(items(base, False), items(runs, True)))
    ahead = _scan(merged, F.lit(-1), walk(lambda top, s: F.greatest(top, s["end"]), lambda top, s: top > s["start"]), RUN)
    back = _scan(F.reverse(ahead), F.lit(1 << 30), walk(lambda low, s: F.least(low, s["start"]), lambda low, s: low < s["end"]), RUN)
    return F.filter(back, lambda s: s["run"] & ~s["touched"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and ``found``, an array of (start, order, end, kind).

    The base patterns come first; strings of high entropy that no base match touches are added
    as kind ``entropy``. Kind order is that of ``BASE``, then entropy. A null text has no
    secrets. Every row is worked on by itself, so nothing is shuffled.
    """
    frame = docs.select("doc_id", whole_text().alias("text"))
    text, spans = F.col("text"), []
    lowered = F.lower(text)
    gates = {
        "assign": lowered.contains("passw") | lowered.contains("secret") | lowered.contains("token") | lowered.contains("key"),
        "access": text.contains("AKIA"),
        "hex": F.lit(True),
    }
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")

    def named(matches: Column, kind: str, order: int) -> Column:
        return F.transform(
            matches,
            lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")),
        ).cast("array<struct<start:int,order:int,end:int,kind:string>>")

    for order, (kind, pattern, group, least) in enumerate(BASE):
        spans.append(F.when(gates[kind], named(F.filter(_matches(text, pattern, group, least), lambda m: m["ok"]), kind, order)).otherwise(none))
    frame = frame.withColumn("base", F.concat(*spans)).withColumn("runs", _matches(text, CANDIDATE, 0, 20, strings=True))
    random = F.filter(_untouched(F.col("base"), F.col("runs")), lambda r: _suspicious(r["string"]))
    added = F.when(F.size("runs") > 0, named(random, "entropy", len(BASE))).otherwise(none)
    return frame.withColumn("added", added).select("doc_id", "base", F.array_sort(F.concat("base", "added")).alias("found"))


def spelled(spans: Column) -> Column:
    """kind:start:end of spans in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
