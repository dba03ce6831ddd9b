"""Sum-of-squares packing of tokenised documents into windows of fixed length."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newsweave.llm.common import whole_text

#: Tokens of a window; id that ends a document; tokens of open windows that are held before they are closed.
WINDOW, END_ID, OPEN_TOKENS = 4096, 2, 1 << 22
#: Words in each of the two generations whose ids a worker remembers.
CACHE_WORDS = 500_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OTHER_SPACE = re.compile("[\x1c-\x1f]")
#: Letters of lower-cased Latin-1, then ASCII marks.
_PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]*)")
#: Byte-level vocabularies write bytes that print nothing as the characters from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordIds:
    """Token ids of whole texts, worked out once per distinct word.

    For vocabularies that lower-case, split at white space and drop it, a text's ids are its
    words' ids in a row, so only words not seen before go to the tokenizer. Words are kept in
    two generations: when the young one is full it becomes the old one, and an old word that
    is met again is young again. At most 2 * CACHE_WORDS words are held.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, text: str) -> np.ndarray:
        if "<|" not in text and _is_latin(text):  # special tokens know upper case from lower
            text = text.lower()
        # str.split also cuts at four control characters that aren't white space to the tokenizer.
        words = re.split("[ \t\n\r\x0b\x0c]+", text) if _OTHER_SPACE.search(text) else text.split()
        missing = set(words).difference(self.young)
        if missing:
            if len(self.young) + len(missing) > CACHE_WORDS:
                self.old, self.young = self.young, {}
                missing = set(words)
            old = self.old
            self.young.update([(w, old[w]) for w in missing if w in old])
            self._learn([w for w in missing if w not in old])
        return np.frombuffer(b"".join(map(self.young.__getitem__, words)), "<u4")

    def _learn(self, words: list[str]) -> None:
        others, tokenize, young = [], self.tokenizer.model.tokenize, self.young
        for word in words:
            match = _PLAIN.fullmatch(word)
            if match is None:
                others.append(word)
                continue
            # Letters, then marks: two pieces to the tokenizer, each of which its model takes as it stands.
            ids = b""
            for piece in match.groups():
                code = young.get(piece) if piece else b""
                if code is None:
                    octets = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
                    code = young[piece] = array("I", [t.id for t in tokenize(octets)]).tobytes()
                ids += code
            young[word] = ids
        for word, code in zip(others, self.tokenizer.encode_batch(others, add_special_tokens=False)):
            young[word] = array("I", code.ids).tobytes()


def _is_latin(text: str) -> bool:
    """No character past U+00FF: all letters then have a lower case of one character and no combining marks."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The words a worker process has learnt serve all tasks that it runs."""
    return WordIds(path)


class SumOfSquares:
    """Online packing that keeps an array of how many open windows stand at each fill level.

    A piece goes to the level where the sum of the squared counts grows least; a new window is
    level 0. Windows left open at the end, or when they hold too many tokens, are closed by
    cutting the pieces of the emptiest ones to fill the fullest, so one window at most stays short.
    """

    def __init__(self, first_id: int, window: int = WINDOW, open_tokens: int = OPEN_TOKENS):
        self.window, self.open_tokens, self.next_id = window, open_tokens, first_id
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        """Rows of windows that this document closes or fills alone."""
        total, whole = len(ids), len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            yield self._row((doc, start, ids[start : start + self.window], total), self._new(), 0)
        if total > whole:
            rest = ids[whole:].copy() if whole else ids  # a view would hold the whole text's ids
            yield from self._place((doc, whole, rest, total))
        if self.held > self.open_tokens:
            yield from self.close()

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _row(self, piece, sequence: int, offset: int) -> tuple:
        doc, start, ids, total = piece
        return doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset

    def _place(self, piece) -> Iterator[tuple]:
        size, n = len(piece[2]), self.counts
        # Taking a window from level h to h + size changes the sum by 2 (n[h + size] - n[h] + 1);
        # a full window leaves the array, a new one comes from nowhere.
        change = 2 * (n[size : self.window] - n[: self.window - size] + 1)
        change[0] = 2 * n[size] + 1
        full = 1 - 2 * n[self.window - size]
        change[1:][n[1 : self.window - size] == 0] = np.iinfo(np.int64).max
        level = int(change.argmin())
        if n[self.window - size] and full <= change[level]:
            level = self.window - size
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        fill = level + size
        if fill == self.window:
            self.held -= level
            yield from self._out(window)
        else:
            self.held += size
            self.counts[fill] += 1
            self.open.setdefault(fill, []).append(window)

    def _out(self, window) -> Iterator[tuple]:
        sequence, offset = self._new(), 0
        for piece in window:
            yield self._row(piece, sequence, offset)
            offset += len(piece[2])

    def close(self) -> Iterator[tuple]:
        """Fill the fullest open windows with what the emptiest hold, cutting pieces where they must be cut."""
        levels = [level for level in sorted(self.open, reverse=True) for _ in self.open[level]]
        windows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        first, last = 0, len(windows) - 1
        while first <= last:
            window, room = windows[first], self.window - levels[first]
            while room and last > first:
                doc, start, ids, total = windows[last].pop()
                cut = max(0, len(ids) - room)
                window.append((doc, start + cut, ids[cut:], total))
                room -= len(ids) - cut
                if cut:
                    windows[last].append((doc, start, ids[:cut], total))
                if not windows[last]:
                    last -= 1
            yield from self._out(window)
            first += 1
        self.counts[:] = 0
        self.open.clear()
        self.held = 0


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, open_tokens: int = OPEN_TOKENS
) -> DataFrame:
    """Pieces of all documents in windows of at most ``window`` tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each input
    partition is packed by itself: no shuffle, and one short window per partition at most. A
    lost task is packed again to the same rows. A task holds the open windows' ids, at most
    ``open_tokens`` of them, and one batch of texts.

    A null or empty text is the end id alone. Rows that repeat an id are packed one by one,
    each with its own ``start``; a null id stays null. An empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids, end = word_ids(tokenizer_path), np.array([end_id], "<u4")
        packer = SumOfSquares(TaskContext.get().partitionId() << 40, window, open_tokens)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                rows += packer.add(None if doc is None or doc != doc else int(doc), np.concatenate([ids.of(text), end]))
            yield _frame(rows)
        yield _frame(list(packer.close()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({n: "Int64" for n in names})
