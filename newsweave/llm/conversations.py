"""Conversation structure repair by a dynamic program over persistent audit strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave.llm.common import SPACES

#: Costs of edits, and of a truncated row that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Where a repaired conversation can stand: nothing yet, after the system row, after a user row, after a pair.
START, SYSTEM, USER, PAIR = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
LEGAL_PAIRS = {"su", "ua", "au"}
#: What the best edits from a pair cost more than those from another place, at most: a system row to delete from the start.
BEHIND = {START: DELETE, SYSTEM: 0}
#: Modulus and base of rolling hashes; rows after which decided edits leave the linked nodes.
MODULUS, BASE, CUT = (1 << 61) - 1, 1_000_003, 1024

REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


# --- audit strings ------------------------------------------------------------------------


class Edit:
    """One edit behind others: a node of a tree whose paths from the root are audit strings.

    ``up[k]`` is the node 2 ** k edits earlier, ``hash`` the rolling hash of the whole path. Prefixes are
    shared, so a string costs one node and its logarithm of pointers.
    """

    __slots__ = ("letter", "depth", "hash", "up")

    def __init__(self, before: Edit | None = None, letter: str = ""):
        self.letter = letter
        if before is None:
            self.depth, self.hash, self.up = 0, 0, []
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * BASE + ord(letter)) % MODULUS
        self.up = up = [before]
        k = 0
        while len(up[k].up) > k:
            up.append(up[k].up[k])
            k += 1

    def ancestor(self, depth: int) -> Edit:
        node, k = self, len(self.up) - 1
        while node.depth > depth:
            k = min(k, len(node.up) - 1)
            while node.up[k].depth < depth:
                k -= 1
            node = node.up[k]
        return node

    def text(self) -> str:
        letters, node = [], self
        while node.up:
            letters.append(node.letter)
            node = node.up[0]
        return "".join(reversed(letters))


def less(a: Edit, b: Edit) -> bool:
    """Whether a's string comes before b's.

    The longest common prefix is searched for through ancestors of halving distance whose hashes differ.
    Equal hashes are then verified: both prefixes are walked to a shared node; letters that differ on the
    way mean a collision, and the earliest of them decides. A verified prefix is shared from then on.
    """
    depth = min(a.depth, b.depth)
    x, y = a.ancestor(depth), b.ancestor(depth)
    if x is y:
        return a.depth < b.depth
    first = None
    if x.hash != y.hash:
        for k in range(len(x.up) - 1, -1, -1):
            if k < len(x.up) and x.up[k].hash != y.up[k].hash:
                x, y = x.up[k], y.up[k]
        first = (x, y)
        x, y = x.up[0], y.up[0]
    p, q, wrong = x, y, None
    while p is not q and p.up:
        if p.letter != q.letter:
            wrong = (p, q)
        p, q = p.up[0], q.up[0]
    if wrong:
        first = wrong
    if first is None:
        return a.depth < b.depth
    if not wrong and first[1].up[0] is not first[0].up[0]:
        first[1].up[0] = first[0].up[0]
    return first[0].letter < first[1].letter


class Place:
    """Cheapest way to one place of the pattern: cost, edits, and the hash of the turns that it keeps."""

    __slots__ = ("cost", "edits", "digest", "empty")

    def __init__(self, cost: int, edits: Edit, digest, empty: bool):
        self.cost, self.edits, self.digest, self.empty = cost, edits, digest, empty

    def then(self, cost: int, letter: str, turn: str | None = None) -> Place:
        """The way with one more edit; ``turn`` is the line that it adds."""
        digest, empty = self.digest, self.empty
        if turn is not None:
            digest, empty = digest.copy(), False
            digest.update((turn if self.empty else "\n" + turn).encode())
        return Place(self.cost + cost, Edit(self.edits, letter), digest, empty)


class Repair:
    """Repairs one conversation row by row, holding four ways and the edits they don't share."""

    def __init__(self):
        self.places: dict[int, Place] = {START: Place(0, Edit(), hashlib.sha256(), True)}
        self.decided: list[str] = []
        self.rows = 0

    def _offer(self, places: dict[int, Place], place: int, way: Place, cost: int, letter: str, turn: str | None = None):
        """Keep the way with one more edit if it is cheaper, or as cheap and earlier in order."""
        held = places.get(place)
        if held is not None and held.cost < way.cost + cost:
            return
        offered = way.then(cost, letter, turn)
        # Equal costs and equal rows: neither string is a prefix of the other, so what follows can't turn their order.
        if held is None or offered.cost < held.cost or less(offered.edits, held.edits):
            places[place] = offered

    def _insert(self):
        places = self.places
        for place in (START, SYSTEM, PAIR):
            if place in places:
                self._offer(places, USER, places[place], INSERT, "I", "user:")
        if USER in places:
            self._offer(places, PAIR, places[USER], INSERT, "I", "assistant:")

    def add(self, role: str, text: str, fault: str | None):
        self._insert()
        extra = TRUNCATED if fault == "truncated" else 0
        after: dict[int, Place] = {}
        for place, way in self.places.items():
            self._offer(after, place, way, DELETE, "D")
            if fault in ("blank", "duplicate"):
                continue
            kept = STEPS.get((place, role[:1]))
            if kept is not None:
                self._offer(after, kept, way, extra, "K", f"{role}:{text}")
            for name in ("user", "assistant"):
                moved = STEPS.get((place, name[0]))
                if moved is not None:
                    self._offer(after, moved, way, REROLE + extra, "R", f"{name}:{text}")
        pair = after.get(PAIR)
        if pair is not None:
            for place, behind in BEHIND.items():
                if place in after and after[place].cost > pair.cost + behind:
                    del after[place]
        self.places = after
        self.rows += 1
        if self.rows % CUT == 0:
            self._cut()

    def _cut(self):
        """Write out the edits that all ways share and start the nodes anew behind them."""
        ways = list(self.places.values())
        depth = min(w.edits.depth for w in ways)
        nodes = [w.edits.ancestor(depth) for w in ways]
        while any(n is not nodes[0] for n in nodes):
            nodes = [n.up[0] for n in nodes]
        self.decided.append(nodes[0].text())
        root = Edit()
        for way in ways:
            rest, way.edits = way.edits.text()[nodes[0].depth :], root
            for letter in rest:
                way.edits = Edit(way.edits, letter)

    def close(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the cheapest repair."""
        self._insert()
        best = None
        for place in (START, PAIR):
            way = self.places.get(place)
            if way and (best is None or way.cost < best.cost or (way.cost == best.cost and less(way.edits, best.edits))):
                best = way
        return best.cost, "".join(self.decided) + best.edits.text(), best.digest.hexdigest()


# --- rows ---------------------------------------------------------------------------------


def prepared(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with null roles and texts as one space."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Prepared rows with damage dealt by a checksum of their key, and ``here``: false for those it drops."""
    rows = prepared(conversations)
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("kind", F.crc32(key.cast("binary")) % 20)
    text = (
        F.when(F.col("kind") <= 1, "")
        .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), (F.col("kind") != 0).alias("here"), F.explode(copies).alias("copy"),
    ).drop("copy")


def _fault(text: Column, repeated: Column) -> Column:
    bare = F.rtrim(text, F.lit(SPACES))
    return (
        F.when(bare == "", "blank")
        .when(repeated, "duplicate")
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    )


def faults(rows: DataFrame) -> DataFrame:
    """``fault`` of every row: blank, duplicate, truncated or null.

    Of rows of a conversation with one role and text the earliest is no duplicate; equal ones of the same
    turn are interchangeable. The window is keyed by the text as well, so a long conversation is spread.
    """
    same = Window.partitionBy("conv_id", "here", "role", "text").orderBy(F.asc_nulls_first("turn"))
    return rows.withColumn("nth", F.row_number().over(same)).withColumn("fault", _fault(F.col("text"), F.col("nth") > 1))


def _reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reports of conversations whose rows stream in order; a conversation may run over many batches."""
    missing = object()
    current, state = missing, None
    for batch in batches:
        out = []
        columns = [batch[c].tolist() for c in ("conv_id", "turn", "role", "text", "here", "fault")]
        for conv, turn, role, text, here, fault in zip(*columns):
            conv = None if conv is None or conv != conv else int(conv)
            if current is missing or conv != current:
                if state is not None:
                    out.append(state.row(current))
                current, state = conv, _Conversation()
            if here:
                state.add(None if turn is None or turn != turn else int(turn), role, text, fault)
        yield _frame(out)
    if state is not None:
        yield _frame([state.row(current)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in REPORT.split(", ")]
    longs = [c.split()[0] for c in REPORT.split(", ") if c.endswith("long")]
    return pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in longs})


class _Conversation:
    def __init__(self):
        self.repair = Repair()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.least = self.most = self.initial = None
        self.turns = self.illegal = 0

    def add(self, turn, role, text, fault):
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn
        if self.initial is not None and self.initial + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.initial = role[:1]
        if fault is not None:
            self.counts[fault] += 1
        self.repair.add(role, text, fault)

    def row(self, conv) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return conv, gaps if gaps < 1 << 63 else None, *self.counts.values(), self.illegal, *self.repair.close()


def repair(rows: DataFrame) -> DataFrame:
    """One report per conversation: faults, and the cheapest edits to ``(s?(ua)+)?``.

    ``rows`` are conv_id, turn, role, text and optionally ``here``; rows that aren't here only name their
    conversation. Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. A conversation's rows are sorted by turn (nulls first), then role and text, and
    stream through a task, which holds four ways with a running hash each and the edits on which they
    don't agree yet: no text is kept, whatever the length. The order of one conversation, and the hash of
    its repaired text, can't be split over tasks.

    Null conv_ids are one conversation. A role without a first character fits no place. A row whose role
    and text came earlier is a duplicate also if its key is repeated. A conversation without rows has
    zeros and an empty audit, gaps past a long are null, an empty table gives no rows.
    """
    if "here" not in rows.columns:
        rows = rows.withColumn("here", F.lit(True))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text", "nth")]
    flat = faults(rows).repartition("conv_id").sortWithinPartitions(*order)
    columns = flat.select(F.col("conv_id"), "turn", "role", "text", "here", "fault")
    return columns.mapInPandas(_reports, REPORT)


def repaired_turns(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text.

    The audit says what became of each row and where rows were inserted; roles follow from the pattern.
    Rows that aren't here must be left out by the caller.
    """
    order = [F.asc_nulls_first(c) for c in ("turn", "role", "text", "nth")]
    numbered = faults(rows.withColumn("here", F.lit(True))).withColumn(
        "at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    )
    letters = F.filter(F.split("audit", ""), lambda x: x != "")
    edits = reports.select(F.col("conv_id").alias("conv"), F.posexplode(letters).alias("edit_at", "edit"))
    before = Window.partitionBy("conv").orderBy("edit_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edits = edits.select(
        "conv", "edit",
        F.when(F.col("edit") != "I", F.count_if(F.col("edit") != "I").over(before)).alias("row"),
        (F.count_if(F.col("edit") != "D").over(before) - 1).alias("position"),
        F.count_if(F.col("edit") != "D").over(Window.partitionBy("conv")).alias("length"),
    ).filter("edit != 'D'")
    joined = edits.join(numbered, F.col("conv").eqNullSafe(F.col("conv_id")) & (F.col("row") == F.col("at")), "left")
    # A repaired conversation of odd length begins with its system row.
    turn = F.when((F.col("position") - F.col("length") % 2) % 2 == 0, "user").otherwise("assistant")
    return joined.select(
        F.col("conv").alias("conv_id"), "position",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(turn).alias("role"),
        F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"),
    )
