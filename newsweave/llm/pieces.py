"""SentencePiece encoding and decoding over a table of distinct chunks."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsweave.llm.common import whole_text
from newsweave.sinks import materialize

MARKER = "▁"
#: Chunks whose ids are sent to every task: how many at most, and how many characters each.
FREQUENT, FREQUENT_CHARS = 1 << 20, 64
#: Distinct chunks that a task counts at a time, and recent texts whose rare chunks it has asked for already.
COUNTED, RECENT = 1 << 19, 100_000
#: Counts are told apart by this many levels an octave; ids that are put out together.
LEVELS, OUT_IDS = 8, 1 << 21
#: Bytes of the place that goes before a rare chunk's ids.
PLACE = 4

COUNTS = "chunk string, n long"
SEGMENTED = "chunk string, n long, ids binary, decoded string"
CODED = "doc_id long, same long, first boolean, code binary, rare array<string>"
ANSWERED = "named long, same long, answer binary"
ENCODED = "doc_id long, ids array<int>, decoded string"


class Chunker:
    """Cuts texts into chunks that the model segments independently, and puts results together again.

    A chunk is a run of whitespace markers and what follows it up to the next one; a line feed starts a
    chunk as well. It is named without its first marker, which every chunk has that doesn't begin with a
    line feed; an empty name is a single marker. That holds for models that only turn spaces into markers
    and put one in front, and none of whose pieces has a marker behind another character or a line
    feed beside one. Where a model isn't such, a text is one chunk.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.model = SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        rules, types = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        plain = plain and not rules.precompiled_charsmap and not proto.trainer_spec.treat_whitespace_as_suffix
        normal = [p.piece for p in proto.pieces if p.type not in (types.CONTROL, types.UNKNOWN, types.BYTE)]
        crossing = re.compile(f"[^{MARKER}]{MARKER}|.\n|\n.", re.DOTALL)
        user = any(p.type == types.USER_DEFINED for p in proto.pieces)
        merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.cuts = plain and merges and not user and MARKER in normal and not any(map(crossing.search, normal))
        self.probe = self.model.encode("x")
        self.shown = self.model.decode(self.probe)

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.cuts:
            return [text]
        text = text.replace(MARKER, " ")
        if "\n" in text:
            text = text.replace("\n", " \n")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        # A marker before each line feed that the text didn't have is taken back; runs of markers stay whole.
        marked = " " + text.replace(" \n", "\n")
        return [c[1:] if c[0] == " " else c for c in re.findall("(?: +|\n)[^ \n]*", marked)]

    def encode(self, chunks: list[str]) -> list[list[int]]:
        found = self.model.encode(chunks, num_threads=1)
        if not self.cuts:
            return found
        lone = self.model.encode("x ")[len(self.probe) :]
        skipped = len(lone)
        return [lone if not c else ids[skipped:] if c[0] == "\n" else ids for c, ids in zip(chunks, found)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """What the ids add to a text when others stand before them."""
        if not self.cuts:
            return self.model.decode(ids, num_threads=1)
        return [t[len(self.shown) :] for t in self.model.decode([self.probe + i for i in ids], num_threads=1)]


_CHUNKERS: dict[str, Chunker] = {}


def chunker(path: str) -> Chunker:
    """One model per worker process."""
    if path not in _CHUNKERS:
        _CHUNKERS[path] = Chunker(path)
    return _CHUNKERS[path]


# --- the frequent part of the table --------------------------------------------------------


def _natural(chunk: str) -> str:
    """The text that a chunk stands for unless its ids say otherwise."""
    return chunk if chunk[:1] == "\n" else " " + chunk.replace(MARKER, " ")


class Frequent:
    """Frequent chunks as tasks use them: numbered from 1, with the ids and the text of each.

    All ids lie in one array; number 0 stands for a rare chunk.
    """

    def __init__(self, chunks: list[str], ids: list[bytes], decoded: dict[int, str], width: str):
        self.number = {c: i for i, c in enumerate(chunks, 1)}
        self.texts = ["", *map(_natural, chunks)]
        for i, text in decoded.items():
            self.texts[i] = text
        self.ids = np.frombuffer(b"".join(ids), width)
        sizes = np.array([0, *map(len, ids)], np.int64) // np.dtype(width).itemsize
        self.ends = np.cumsum(sizes)
        self.sizes = sizes


_TABLES: dict[str, Frequent] = {}


def _frequent(name: str, sent: Broadcast) -> Frequent:
    """Built once per worker process, which holds the latest table only."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = Frequent(*sent.value)
    return _TABLES[name]


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = chunker(path).split, Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                found.update(split(text))
                if len(found) > COUNTED:
                    yield _repeated(found)
                    found.clear()
        yield _repeated(found)

    return count


def _repeated(found: Counter) -> pa.RecordBatch:
    rows = [(c, n) for c, n in found.items() if n > 1 and len(c) <= FREQUENT_CHARS]
    return pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["chunk", "n"]
    )


def _width(path: str) -> str:
    return "<u2" if chunker(path).model.get_piece_size() <= 1 << 16 else "<u4"


def _segmenter(path: str):
    """Ids of each chunk, and its text where that isn't the natural one."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, width = chunker(path), _width(path)
        for batch in batches:
            chunks = batch["chunk"].to_pylist()
            ids = own.encode(chunks)
            texts = [None if t == _natural(c) else t for c, t in zip(chunks, own.decode(ids))]
            yield pa.RecordBatch.from_arrays(
                [batch["chunk"], batch["n"], pa.array([np.array(i, width).tobytes() for i in ids], pa.binary()),
                 pa.array(texts, pa.string())],
                names=["chunk", "n", "ids", "decoded"],
            )

    return segment


def frequent_chunks(docs: DataFrame, path: str, most: int = FREQUENT) -> DataFrame:
    """``chunk, n, ids, decoded`` of the most frequent chunks, ``most`` rows at most.

    Tasks count their chunks and leave out those they met once, so a chunk's count may be too low; that
    decides only how its ids travel. The cut is the least level of counts with few enough chunks above.
    """
    counted = docs.mapInArrow(_counter(path), COUNTS).groupBy("chunk").agg(F.sum("n").alias("n"))
    level = F.floor(F.log2("n") * LEVELS).cast("int")
    counted = materialize(counted.withColumn("level", level), "chunks")
    taken, cut = 0, None
    # Counts are longs: 64 octaves at most.
    for row in counted.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        taken += row["n"]
        if taken > most:
            break
        cut = row["level"]
    above = counted.filter(F.lit(False) if cut is None else F.col("level") >= cut)
    return above.select("chunk", "n").mapInArrow(_segmenter(path), SEGMENTED)


def _send(spark: SparkSession, table: DataFrame, path: str) -> tuple[str, Broadcast]:
    """The frequent chunks, the most frequent ones first, to all tasks; their number and length are bounded."""
    rows = table.toArrow().sort_by([("n", "descending"), ("chunk", "ascending")])
    decoded = {i: t for i, t in enumerate(rows["decoded"].to_pylist(), 1) if t is not None}
    value = (rows["chunk"].to_pylist(), rows["ids"].to_pylist(), decoded, _width(path))
    return uuid.uuid4().hex, spark.sparkContext.broadcast(value)


# --- documents ----------------------------------------------------------------------------


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 21 in seven bits a byte, the low ones first: frequent chunks take a byte or two."""
    sizes = 1 + (numbers >= 1 << 7) + (numbers >= 1 << 14)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for place in range(3):
        own = sizes > place
        more = np.where(sizes[own] > place + 1, 0x80, 0)
        out[(ends - sizes)[own] + place] = (numbers[own] >> 7 * place & 0x7F) | more
    return out.tobytes()


def _numbers(code: bytes) -> np.ndarray:
    octets = np.frombuffer(code, np.uint8).astype(np.int64)
    ends = np.flatnonzero(octets < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    numbers = octets[starts] & 0x7F
    for place in (1, 2):
        own = ends - starts >= place
        numbers[own] |= (octets[starts[own] + place] & 0x7F) << 7 * place
    return numbers


def _coder(path: str, name: str, sent: Broadcast):
    """Documents as numbers of frequent chunks, with the rare ones spelled out."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number, asked = chunker(path).split, _frequent(name, sent).number.get, {}
        for batch in batches:
            codes, rare, first = [], [], []
            for key in zip(batch["doc_id"].to_pylist(), batch["same"].to_pylist()):
                first.append(key not in asked)
                asked[key] = True
            for text in batch["text"].to_pylist():
                chunks = split(text)
                numbers = np.array([number(c, 0) for c in chunks], np.int64)
                codes.append(_packed(numbers))
                rare.append([chunks[i] for i in np.flatnonzero(numbers == 0).tolist()])
            if len(asked) > RECENT:
                asked.clear()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["same"], pa.array(first, pa.bool_()), pa.array(codes, pa.binary()),
                 pa.array(rare, pa.list_(pa.string()))],
                names=["doc_id", "same", "first", "code", "rare"],
            )

    return code


def _answerer(path: str):
    """Place and ids of rare chunks that stream in order, each distinct one segmented once."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, width = chunker(path), _width(path)
        last, known = None, b""
        for batch in batches:
            chunks = batch["chunk"].to_pylist()
            new = [c for c, before in zip(chunks, [last, *chunks]) if c != before]
            segmented = iter([np.array(i, width).tobytes() for i in own.encode(new)])
            out = []
            for chunk, at in zip(chunks, batch["at"].to_pylist()):
                if chunk != last:
                    last, known = chunk, next(segmented)
                out.append(at.to_bytes(PLACE, "little") + known)
            yield pa.RecordBatch.from_arrays(
                [batch["named"], batch["same"], pa.array(out, pa.binary())], names=["named", "same", "answer"]
            )

    return answer


def _joiner(path: str, name: str, sent: Broadcast):
    """Ids and decoded texts of documents from their chunks in order."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, width, table = chunker(path), _width(path), _frequent(name, sent)
        end = np.array([own.model.eos_id()], np.int32)
        for batch in batches:
            # All rare chunks of the batch in order of row and place, decoded in one call.
            rows = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(batch["answers"]), 0))
            flat = batch["answers"].flatten().to_pylist()
            at = np.frombuffer(b"".join(a[:PLACE] for a in flat), f"<u{PLACE}")
            answers = [np.frombuffer(flat[i], width, offset=PLACE) for i in np.lexsort((at, rows)).tolist()]
            spelled = own.decode([a.tolist() for a in answers])
            docs, parts, texts, held, at = [], [], [], 0, 0
            for doc, code in zip(batch["doc_id"].to_pylist(), batch["code"].to_pylist()):
                numbers = _numbers(code)
                upto = at + int((numbers == 0).sum())
                ids, text = _spelled(own, table, numbers, answers[at:upto], spelled[at:upto])
                at = upto
                docs.append(doc)
                parts.append(np.concatenate([ids, end]))
                texts.append(text)
                held += len(ids)
                if held > OUT_IDS:
                    yield _rows(docs, parts, texts)
                    docs, parts, texts, held = [], [], [], 0
            yield _rows(docs, parts, texts)

    return join


def _spelled(
    own: Chunker, table: Frequent, numbers: np.ndarray, rare: list[np.ndarray], spelled: list[str]
) -> tuple[np.ndarray, str]:
    if not len(numbers):
        return np.empty(0, np.int32), ""
    holes = np.flatnonzero(numbers == 0)
    sizes = table.sizes[numbers]
    sizes[holes] = [len(r) for r in rare]
    ends = np.cumsum(sizes)
    places = np.repeat(table.ends[numbers] - table.sizes[numbers] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
    if len(holes):
        known = np.repeat(numbers > 0, sizes)
        ids = np.empty(len(places), np.int32)
        ids[known] = table.ids[places[known]]
        ids[~known] = np.concatenate(rare)
    else:
        ids = table.ids[places].astype(np.int32)
    pieces = [table.texts[n] for n in numbers.tolist()]
    for at, text in zip(holes.tolist(), spelled):
        pieces[at] = text
    pieces[0] = own.model.decode(ids[: ends[0]].tolist())  # with nothing before it, its marker is the one put in front
    return ids, "".join(pieces)


def _rows(docs: list, parts: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(texts, pa.string())],
        names=["doc_id", "ids", "decoded"],
    )


def encode(docs: DataFrame, model_path: str, most: int = FREQUENT) -> DataFrame:
    """``doc_id, ids, decoded`` of every row: the ids with an end id, and the text that they decode to.

    Each distinct chunk is segmented once: frequent ones first, at most ``most`` of 64 characters at most,
    whose ids are broadcast; then the rest, which meet by chunk in order. Documents travel as the
    packed numbers of their frequent chunks and are joined by id and a hash of the text with the ids of their rare
    chunks, which fill the gaps by position. Nothing is collected beyond a document; the frequent part of
    the table is what the driver sees.

    A null or empty text is the end id alone and decodes to an empty one. Rows that share an id are told
    apart by 64 bits of their text; equal rows each come out. A null id stays null. An empty table gives
    no rows. A text without spaces is one chunk, however long.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("same"), "text")
    sent = _send(docs.sparkSession, frequent_chunks(texts.select("text"), model_path, most), model_path)
    coded = texts.mapInArrow(_coder(model_path, *sent), CODED)
    # Equal texts have equal ids, so a null id may share answers with the one that stands for it here.
    coded = coded.withColumn("named", F.coalesce("doc_id", F.lit(-(2**63))))
    asked = coded.filter("first").select("named", "same", F.posexplode("rare").alias("at", "chunk"))
    answered = asked.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_answerer(model_path), ANSWERED)
    answers = answered.groupBy("named", "same").agg(F.collect_set("answer").alias("answers"))
    met = coded.select("doc_id", "named", "same", "code").join(answers, ["named", "same"], "left")
    return met.select("doc_id", "code", "answers").mapInArrow(_joiner(model_path, *sent), ENCODED)
