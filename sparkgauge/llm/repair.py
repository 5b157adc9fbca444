r"""Conversation structure repair by lazy weighted determinisation.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``. A weighted automaton of four states (nothing
yet, after system, after user, after assistant) reads one symbol a row, and its arcs are the edits: keep, rerole, delete,
and insert between rows. Reading from the last row to the first, the costs of the four states, less their minimum, are one
state of a determinised automaton. Such states are made when they are first met and kept in a table of (state, symbol) ->
(state, weight), so a row costs one look into the table, and the weights add up to the cheapest repair. Going back against
that reading, from the first row to the last, only tight arcs are followed, of several the one of least letter: as the
costs to the end are known, that gives the least of all cheapest audits.

Rows reach their conversation by one shuffle; two sorts within the partitions, which spill, mark repeated texts and restore
the order of turns. A task streams over its rows. Of a conversation it holds a letter and a table entry a row, no more than
the audit that it must return as one value; texts wait in a file beyond SPOOL bytes until the hash takes them, one by one.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Costs of the edits and of keeping a row that is cut off.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
BLANK = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: States by number: nothing yet, after system, after user, after assistant. Where each role leads, and where a repair may end.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL, NEXT = (0, 3), {0: "u", 1: "u", 2: "a", 3: "u"}
ROLES = {"u": "user", "a": "assistant"}
NEVER = 1 << 40
#: Bytes of a conversation's texts that stay in memory.
SPOOL = 16 << 20
SUMMARY = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
REPAIRED = "conv_id bigint, position bigint, edit string, role string, text string"


def arcs(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, next state, cost) of the edits of a row. Symbols: ``x`` must go; the initial s, u, a or o for others, a capital when the text is cut off."""
    yield "D", state, DELETE
    if symbol != "x":
        more = CUT_OFF * symbol.isupper()
        if (state, symbol.lower()) in STEP:
            yield "K", STEP[state, symbol.lower()], more
        yield "R", STEP[state, NEXT[state]], REROLE + more


class Determinised:
    """The automaton over cost vectors; states and transitions are made when they are first needed, and shared by all conversations of a task."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.traces: dict[tuple[int, str, int], tuple[str, int]] = {}
        self.end = self._state([0 if q in FINAL else NEVER for q in range(4)])[0]

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The number of the normalised vector, after insertions, and what was taken off."""
        for _ in range(2):  # a third insertion in a row never pays
            costs = [min(c, INSERT + costs[STEP[q, NEXT[q]]]) for q, c in enumerate(costs)]
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """From the costs after a row to those before it."""
        if (state, symbol) not in self.table:
            after = self.vectors[state]
            self.table[state, symbol] = self._state([min(cost + after[to] for _, to, cost in arcs(symbol, q)) for q in range(4)])
        return self.table[state, symbol]

    def scan(self, symbols: str) -> tuple[int, array]:
        """The cost of the cheapest repair, and the state after every row, from the end's to that before the first."""
        at, states, cost = self.end, array("I", [self.end]), 0
        for symbol in reversed(symbols):
            at, weight = self.step(at, symbol)
            cost += weight
            states.append(at)
        return cost + self.vectors[at][0], states

    def _tight(self, after: int, symbol: str, q: int) -> tuple[str, int]:
        """The letters from state q through a row, insertions before it included, and the state reached."""
        if (after, symbol, q) not in self.traces:
            before, weight = self.step(after, symbol)
            have, then, letters, at = self.vectors[before], self.vectors[after], "", q
            while True:
                ways = [(letter, to) for letter, to, cost in arcs(symbol, at) if have[at] + weight == cost + then[to]]
                if have[at] == INSERT + have[STEP[at, NEXT[at]]]:
                    ways.append(("I", STEP[at, NEXT[at]]))
                letter, at = min(ways)
                letters += letter
                if letter != "I":
                    break
            self.traces[after, symbol, q] = letters, at
        return self.traces[after, symbol, q]

    def trace(self, symbols: str, states: array) -> str:
        """The least audit of all that cost as little as the scan says."""
        out, q, n = [], 0, len(symbols)
        for i, symbol in enumerate(symbols):
            letters, q = self._tight(states[n - 1 - i], symbol, q)
            out.append(letters)
        while q not in FINAL:
            q = STEP[q, NEXT[q]]
            out.append("I")
        return "".join(out)


def edits(audit: str, initials: Iterator[str]) -> Iterator[tuple[str, str | None]]:
    """(letter, role initial after it) of every edit; the initial is None for a row that goes."""
    q = 0
    for letter in audit:
        if letter == "D":
            next(initials)
            yield letter, None
            continue
        role = next(initials) if letter == "K" else NEXT[q]
        if letter == "R":
            next(initials)
        q = STEP[q, role]
        yield letter, role


class _Conversation:
    """What a task holds of the conversation that it is reading."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols, self.texts = conv_id, [], tempfile.SpooledTemporaryFile(SPOOL)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last = self.least = self.most = None

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        kind = initial if initial in ("s", "u", "a") else "o"
        self.symbols.append("x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind)
        r, t = role.encode(), text.encode()
        self.texts.write(struct.pack("<QQ", len(r), len(t)) + r + t)

    def repaired(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """(letter, role, text) of all rows of the repaired conversation; the deleted ones are read over."""
        self.texts.seek(0)
        for letter, initial in edits(audit, (s.lower() for s in self.symbols)):
            role, text = "", ""
            if letter != "I":
                nr, nt = struct.unpack("<QQ", self.texts.read(16))
                role, text = self.texts.read(nr).decode(), self.texts.read(nt).decode()
            if initial is not None:
                yield letter, role if letter == "K" else ROLES[initial], text

    def summary(self, cost: int, audit: str) -> dict:
        digest = hashlib.sha256()
        for i, (_, role, text) in enumerate(self.repaired(audit)):
            digest.update(f"{chr(10) * (i > 0)}{role}:{text}".encode())
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()}


def _stream(full: bool):
    names = [c.split()[0] for c in (REPAIRED if full else SUMMARY).split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256", "edit", "role", "text") else pa.int64()) for n in names])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, now, out, held = Determinised(), None, [], 0

        def close() -> Iterator[dict]:
            symbols = "".join(now.symbols)
            cost, states = automaton.scan(symbols)
            audit = automaton.trace(symbols, states)
            if full:
                yield from ({"conv_id": now.conv_id, "position": i, "edit": letter, "role": role, "text": text} for i, (letter, role, text) in enumerate(now.repaired(audit)))
            else:
                yield now.summary(cost, audit)
            now.texts.close()

        def rows() -> Iterator[dict]:
            nonlocal now
            for batch in batches:
                for conv_id, turn, role, text, fault, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now is None or now.conv_id != conv_id:
                        if now is not None:
                            yield from close()
                        now = _Conversation(conv_id)
                    if not gone:
                        now.add(turn, role, text, fault)
            if now is not None:
                yield from close()

        for row in rows():
            out.append(row)
            held += len(row.get("audit") or row.get("text") or "")
            if len(out) == 1000 or held > SPOOL:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    return stream


def with_faults(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, gone: rows gathered by conversation, in the order of its turns, with the first fault of each.

    Ties of a turn go by role, then text. Faults: blank (nothing but white space), duplicate (role and text stood in an
    earlier row), truncated (the last other character isn't one of ``.!?``), else null. Rows with ``gone`` only say that
    the conversation exists; they are in nobody's way.
    """
    gone = F.col("gone") if "gone" in chats.columns else F.lit(False)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = chats.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), plain("role"), plain("text"), gone.alias("gone"))
    what = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    rows = rows.withColumn("what", F.when(F.col("gone"), F.lit("")).otherwise(what)).repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "what").orderBy(F.col("turn").asc_nulls_first())) > 1
    bare = F.rtrim(F.col("text"), F.lit(BLANK))
    fault = F.when(bare == "", "blank").when(F.col("earlier"), "duplicate").when(~F.right(bare, F.lit(1)).isin(*ENDS), "truncated")
    rows = rows.withColumn("earlier", earlier).withColumn("fault", fault).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "earlier")
    return rows.select("conv_id", "turn", "role", "text", "fault", "gone")


def repair(chats: DataFrame) -> DataFrame:
    """Per conversation: faults, the cost and audit of the cheapest repair, and a hash of the repaired conversation (SUMMARY).

    chats has conv_id, turn, role, text, and may have ``gone``, true for rows that no longer exist: a conversation of such rows
    only has zeros, an empty audit and the hash of the empty string. A null role or text is one space; a null turn comes
    first and doesn't count for gaps; rows without a conv_id are one conversation. Repeated rows are duplicates of the
    first. Other columns aren't read, and an empty table gives no row. The edits' letters, D, I, K and R, are ordered as
    in ASCII.
    """
    return with_faults(chats).mapInArrow(_stream(False), SUMMARY)


def repaired_rows(chats: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, position (from 0), edit (I, K or R), role, text; see repair()."""
    return with_faults(chats).mapInArrow(_stream(True), REPAIRED)


def damage(chats: DataFrame) -> DataFrame:
    """chats (conv_id, turn, role, text) with the faults that crc32(``conv_id:turn``) % 20 deals out, and ``gone`` on dropped rows.

    Nulls are one space, in the hash too. 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its
    role user.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = chats.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), fate.alias("fate"))
    text: Column = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"), copies.alias("copy")).drop("copy")
