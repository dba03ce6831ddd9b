"""Personal data by fixed patterns and a skip-chain conditional random field over each document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newsweave.llm.common import whole_text

KINDS = ["email", "ip", "card", "phone"]
#: Documents that train the field, chosen by a hash of their ids, and the mentions taken of them at most.
SAMPLE_DOCS, SAMPLE_MENTIONS = 2_000, 50_000
#: Probability from which a mention is added.
LEAST = 0.8
#: Places between neighbours on the chain.
NEAR = 60
#: Messages pass until none changes by more than SETTLED over the links of a mention. No path is longer than the mentions
#: are many, so the bound on the rounds grows with them.
SETTLED, ROUNDS, ROUNDS_A_MENTION = 1e-3, 100, 4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs behind a border match what plain runs match, without trying a run again from its middle.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What else may be personal data: words around an at sign, spelled out or not, and numbers of seven digits and more.
_PART = r"[^\s@<>\"'(),;:\[\]]"
_AT = re.compile(
    rf"(?<!{_PART}){_PART}++(?:\x20?(?:\[at\]|\(at\))\x20?|@){_PART}+(?:\x20?(?:\[dot\]|\(dot\))\x20?{_PART}+)*"
)
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches as (kind, start, end) by kind, then start."""
    spans, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            spans.append(("email", start, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


@dataclass
class Mention:
    start: int
    end: int
    label: int  # 0 other, else 1 + kind
    text: str


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[Mention]:
    """Base matches and other candidates in the order of the text; overlapping candidates give way."""
    found = [Mention(a, b, 1 + KINDS.index(kind), text[a:b]) for kind, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    more = []
    if "@" in text or "(at)" in text or "[at]" in text:
        more += [m.span() for m in _AT.finditer(text)]
    more += [m.span() for m in _NUMBER.finditer(text) if sum(map(str.isdigit, m[0])) >= 7]
    i = 0
    last = 0
    for a, b in sorted(more):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= last and not (i < len(taken) and taken[i][0] < b):
            found.append(Mention(a, b, 0, text[a:b]))
            last = b
    return sorted(found, key=lambda m: (m.start, m.end))


def features(text: str, blurred: bool = False) -> np.ndarray:
    """What a mention looks like; ``blurred`` leaves out the marks by which the base patterns know it."""
    digits = sum(map(str.isdigit, text))
    at = "@" in text or "(at)" in text or "[at]" in text
    out = np.zeros(14)
    out[0] = 1
    if not blurred:
        out[1] = "+" in text
        out[2] = at and "." in text.rpartition("@")[2]
        out[3] = re.fullmatch(r"[0-9]+(\.[0-9]+){3}", text) is not None
        out[4] = 13 <= digits <= 19 and not at and luhn(_NOT_DIGIT.sub("", text))
        out[12] = "(" in text or " " in text
        out[13] = text.count(".") >= 2
    out[5] = at
    out[6 + (np.searchsorted([8, 10, 13, 16, 20], digits, side="right") if not at else 0)] = 1
    return out


def _keys(mention: Mention) -> list[str]:
    """Mentions that share a key are the same (first key) or similar (second)."""
    text = mention.text.lower().replace("[at]", "@").replace("(at)", "@").replace("[dot]", ".").replace("(dot)", ".").replace(" ", "")
    if "@" in text:
        return ["=" + text.strip("."), "~" + text.partition("@")[0]]
    digits = _NOT_DIGIT.sub("", text)
    return ["=" + digits, "~" + digits[-9:]]


def edges(found: list[Mention]) -> np.ndarray:
    """Links (i, j, type): 0 neighbours on the chain, 1 same, 2 similar.

    Mentions of one key are linked to one hub, its first base match or else its first mention, not
    all pairs: however long the document, a base match is one link away. A mention that is the same
    as a base match has no link to similar ones.
    """
    keys = [_keys(mention) for mention in found]
    hubs: dict[str, int] = {}
    for j, mention in enumerate(found):
        for key in keys[j]:
            if not found[hubs.setdefault(key, j)].label and mention.label:
                hubs[key] = j
    out = []
    for j, mention in enumerate(found):
        if j and mention.start - found[j - 1].end <= NEAR:
            out.append((j - 1, j, 0))
        same, similar = (hubs[key] for key in keys[j])
        if same != j:
            out.append((same, j, 1))
        if len(keys[j][1]) >= 6 and similar not in (same, j) and not found[same].label:
            out.append((similar, j, 2))
    return np.array(out, np.int64).reshape(-1, 3)


def _repeats(found: list[Mention]) -> np.ndarray:
    """Links like those of ``edges``, but of each mention to the last one of its key.

    Weights are per link and are learnt from these: no mention has more than a few, so one long
    document doesn't set the scale of the counts.
    """
    out, last = [], {}
    for j, mention in enumerate(found):
        if j and mention.start - found[j - 1].end <= NEAR:
            out.append((j - 1, j, 0))
        same, similar = _keys(mention)
        if same in last:
            out.append((last[same], j, 1))
        elif len(similar) >= 6 and similar in last:
            out.append((last[similar], j, 2))
        last[same] = last[similar] = j
    return np.array(out, np.int64).reshape(-1, 3)


N_LABELS, N_FEATURES, N_TYPES = 1 + len(KINDS), 14, 3


def training_rows(text: str, rng: np.random.Generator) -> list[tuple]:
    """Pseudo-likelihood rows of one document: label, features, labels of linked mentions by type.

    Labels are those of the base patterns. A candidate linked to a base match is left out: the
    patterns don't say what it is. Each mention is also shown as a blurred repeat of itself, so
    the field learns how far a repeat speaks for a mention whose own marks are missing.
    """
    found = mentions(text, base_spans(text))
    near = np.zeros((len(found), N_TYPES, N_LABELS))
    doubtful = np.zeros(len(found), bool)
    for i, j, t in _repeats(found):
        near[i, t, found[j].label] += 1
        near[j, t, found[i].label] += 1
    for i, j, t in edges(found):
        if t and (found[i].label == 0) != (found[j].label == 0):
            doubtful[[i, j]] |= [found[i].label == 0, found[j].label == 0]
    out = []
    for i, mention in enumerate(found):
        if doubtful[i]:
            continue
        out.append((mention.label, features(mention.text), near[i].ravel()))
        repeat = near[i].copy()
        repeat[1 + int(rng.integers(2)), mention.label] += 1
        out.append((mention.label, features(mention.text, blurred=True), repeat.ravel()))
    return out


@dataclass
class Field:
    """Weights of the field: label by feature, and a symmetric table for each type of link."""

    unary: np.ndarray
    pairs: np.ndarray

    def probabilities(self, found: list[Mention], links: np.ndarray) -> np.ndarray:
        """Marginal label probabilities by loopy belief propagation; base matches keep their labels."""
        scores = np.stack([features(m.text) for m in found]) @ self.unary.T
        for i, m in enumerate(found):
            if m.label:
                scores[i] = -50.0
                scores[i, m.label] = 50.0
        if len(links):
            source = np.concatenate([links[:, 0], links[:, 1]])
            target = np.concatenate([links[:, 1], links[:, 0]])
            table = self.pairs[np.concatenate([links[:, 2], links[:, 2]])]
            back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
            messages = np.zeros((len(source), N_LABELS))
            settled = SETTLED / np.bincount(target).max()  # a hub adds up the errors of all its links
            for _ in range(ROUNDS + ROUNDS_A_MENTION * len(found)):
                belief = scores.copy()
                np.add.at(belief, target, messages)
                outgoing = (belief[source] - messages[back])[:, :, None] + table
                new = np.logaddexp.reduce(outgoing, axis=1)
                new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
                change = np.abs(new - messages).max()
                messages = 0.5 * messages + 0.5 * new  # damped, since loops may swing
                if change < settled:
                    break
            np.add.at(scores, target, messages)
        return np.exp(scores - np.logaddexp.reduce(scores, axis=1, keepdims=True))


def fit(labels: np.ndarray, shapes: np.ndarray, near: np.ndarray, rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximum pseudo-likelihood by gradient ascent with momentum."""
    x = np.hstack([shapes, near])
    x_max = np.maximum(np.abs(x).max(axis=0), 1.0)
    x = x / x_max
    weights = np.zeros((N_LABELS, x.shape[1]))
    speed = np.zeros_like(weights)
    truth = np.eye(N_LABELS)[labels]
    for _ in range(rounds):
        scores = x @ weights.T
        guess = np.exp(scores - scores.max(axis=1, keepdims=True))
        guess /= guess.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + (truth - guess).T @ x / len(x) - decay * weights
        weights = weights + rate * speed
    weights = weights / x_max
    pairs = weights[:, N_FEATURES:].reshape(N_LABELS, N_TYPES, N_LABELS).transpose(1, 0, 2)
    return Field(weights[:, :N_FEATURES], (pairs + pairs.transpose(0, 2, 1)) / 2)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_mentions: int = SAMPLE_MENTIONS) -> Field | None:
    """Fit the field on a bounded sample: documents with candidates, those of the smallest hashed ids.

    Only feature rows come to the driver, at most ``sample_mentions``. Without any, no field.
    """
    text = whole_text()
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    fitting = docs.filter(text.rlike(r"@|[0-9][0-9 ().-]{5,}[0-9]") & doc_id.isNotNull()).select(doc_id)
    chosen = fitting.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    sample = docs.select(doc_id, text.alias("text")).join(F.broadcast(chosen), "doc_id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, body in zip(batch["doc_id"], batch["text"]):
                rows = training_rows(body, np.random.default_rng(int(doc) & 0xFFFFFFFF))
                out += [(int(doc), at, label, a.tolist(), b.tolist()) for at, (label, a, b) in enumerate(rows)]
            yield pd.DataFrame(out, columns=["doc_id", "at", "label", "shape", "near"])

    rows = sample.mapInPandas(run, "doc_id long, at int, label int, shape array<double>, near array<double>")
    rows = rows.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(sample_mentions).toPandas()
    if rows.empty:
        return None
    return fit(rows["label"].to_numpy(np.int64), np.stack(rows["shape"].to_list()), np.stack(rows["near"].to_list()))


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field | None, least: float = LEAST) -> list[tuple[str, int, int]]:
    """Candidates that the field takes for personal data, in any document that has candidates.

    The marginal alone decides, whether or not a mention resembles another one.
    """
    if field is None:
        return []
    found = mentions(text, base)
    if all(m.label for m in found):
        return []
    chances = field.probabilities(found, edges(found))
    kinds = chances[:, 1:].argmax(axis=1)
    return [(KINDS[k], m.start, m.end) for m, p, k in zip(found, chances, kinds) if not m.label and p[0] <= 1 - least]


def find_personal_data(docs: DataFrame, least: float = LEAST, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, the number of base matches of each kind, base, spans.

    ``base`` and ``spans`` are spelled kind:start:end, by kind and start, with commas between;
    places are code points. ``spans`` adds what the field finds, whose labels agree over
    repeated and similar mentions of a document. Null texts have none. Every row is worked on
    by itself; only the bounded training sample meets on the driver.
    """
    field = train(docs, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                base = base_spans(text)
                spans = base + added_spans(text, base, field, least)
                spans.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                counts = [sum(kind == k for k, _, _ in base) for kind in KINDS]
                out.append((*counts, *(",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in (base, spans))))
            frame = pd.DataFrame(out, columns=[f"n_{k}" for k in KINDS] + ["base", "spans"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield frame

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInPandas(run, schema)
