"""Repair of conversations to ``(system? (user assistant)+)?`` by weighted interval parsing (CYK).

The repair grammar is in Chomsky normal form. Its symbols N[p,q] stand for edited rows that take the
wanted order of roles from state p to state q: nothing yet, after the system turn, after a user
turn, after an assistant turn. N[p,q] becomes N[p,r] N[r,q], or one row kept, given another role or
deleted; inserted turns derive the empty span, and each cell is closed under them on both sides. A
cell of a span is the least (cost, audit) of each symbol. All cuts of a span derive the same edits
here, so every span is cut once, in its middle, and the chart is filled by length: 1, 2, 4 and so on.
Two audits of one cost and span are never a prefix of each other (the longer one would hold more
insertions), so the least audit of a span is made of least audits.

A conversation is read as a sorted stream. Spans go up to a block of rows; then only the best parse
up to each state is kept, with the digest of its repaired text, so that no task holds the texts of
more than one block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a block.
BLOCK = 4096
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role's first letter leads from a state.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
#: The damage, by the remainder of the row's checksum.
DAMAGES, DROPPED, EMPTIED, UNSTOPPED, REPEATED, MADE_USER = 20, 0, 1, 2, 3, 4

NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")
UNFINISHED = re.compile(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\Z")

Cell = tuple[tuple[tuple[int, str] | None, ...], ...]
#: Edits of a row: its role's first letter, whether it must go, whether it is cut off.
Kind = tuple[str, bool, bool]


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two spans on end."""

    def least(p: int, q: int) -> tuple[int, str] | None:
        found = [(a[0] + b[0], a[1] + b[1]) for r in range(4) if (a := left[p][r]) and (b := right[r][q])]
        return min(found, default=None)

    return tuple(tuple(least(p, q) for q in range(4)) for p in range(4))


@lru_cache(1)
def insertions() -> Cell:
    """The cell of the empty span: each state from each other by inserted turns alone."""
    one = [[(0, "") if p == q else None for q in range(4)] for p in range(4)]
    for (p, letter), q in STEPS.items():
        if letter != "s":
            one[p][q] = (INSERT, "I")
    cell = tuple(map(tuple, one))
    while (further := joined(cell, cell)) != cell:
        cell = further
    return cell


@lru_cache(64)
def row_cell(kind: Kind) -> Cell:
    """The cell of one row."""
    initial, must_go, cut_off = kind
    stays = TRUNCATED if cut_off else 0
    cell: list[list] = [[(DELETE, "D") if p == q else None for q in range(4)] for p in range(4)]
    if not must_go:
        for (p, letter), q in STEPS.items():
            if letter == initial:
                cell[p][q] = (stays, "K")
            elif letter != "s":
                cell[p][q] = min(cell[p][q] or (REROLE + stays, "R"), (REROLE + stays, "R"))
    return joined(joined(insertions(), tuple(map(tuple, cell))), insertions())


@lru_cache(1 << 14)
def _short(kinds: tuple[Kind, ...]) -> Cell:
    return _chart([row_cell(k) for k in kinds])


def _chart(cells: list[Cell]) -> Cell:
    """The cell of the whole, from spans of one length to spans of twice that length."""
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def parse(kinds: list[Kind], whole: int = 8) -> Cell:
    """The cell of a block of rows; spans of up to ``whole`` rows that were met before are known."""
    if not kinds:
        return insertions()
    return _chart([_short(tuple(kinds[i : i + whole])) for i in range(0, len(kinds), whole)])


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, int | None, str, str]]:
    """(edit, row, role, text) of each edit of the audit that begins in a state; row is None for insertions."""
    at = 0
    for edit in audit:
        role, text = rows[at] if edit != "I" else ("", "")
        if edit in "RI":
            role = ROLES[USER if (state, "u") in STEPS else ASSISTANT]
        if edit != "D":
            state = STEPS[state, role[:1]]
        yield edit, None if edit == "I" else at, role, text
        at += edit != "I"


@dataclass
class Path:
    """The best parse of the rows so far that ends in a state, and the digest of its lines."""

    cost: int = 0
    audit: list[str] = field(default_factory=list)
    lines: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def on(self, cost: int, audit: str, rows: list[tuple[str, str]], state: int) -> Path:
        digest, lines = self.digest.copy(), self.lines
        for edit, _, role, text in repaired(rows, audit, state):
            if edit != "D":
                digest.update(f"{'\n' if lines else ''}{role}:{text}".encode())
                lines += 1
        return Path(self.cost + cost, [*self.audit, audit], lines, digest)


class Conversation:
    """Faults and best repair of one conversation, whose rows come in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.rows: list[tuple[str, str]] = []
        self.kinds: list[Kind] = []
        self.seen: set[bytes] = set()
        self.paths = {START: Path()}
        self.turns = [None, None, 0]  # least, greatest, different ones
        self.last = None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            low, high, count = self.turns
            self.turns = [turn if low is None else low, turn, count + (turn != high)]
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        # the length tells where the role ends; 16 bytes of a cryptographic digest stand for the row
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        blank = not NOT_BLANK.search(text)
        duplicate = not blank and mark in self.seen
        truncated = not blank and not duplicate and bool(UNFINISHED.search(text[-64:]) or not NOT_BLANK.search(text[-64:]) and UNFINISHED.search(text))
        self.seen.add(mark)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.rows.append((role, text))
        self.kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "", blank or duplicate, truncated))
        if len(self.rows) == BLOCK:
            self.close(range(4))

    def close(self, states: Iterator[int]) -> None:
        """The rows since the last block, parsed; the best way to each of the states."""
        cell, found = parse(self.kinds), {}
        for q in states:
            ways = [(path.cost + way[0], way[1], p) for p, path in self.paths.items() if (way := cell[p][q])]
            if ways:
                # equal costs: the audits up to here decide, and those are never prefixes of each other
                least = min(w[0] for w in ways)
                _, audit, p = min((w for w in ways if w[0] == least), key=lambda w: "".join([*self.paths[w[2]].audit, w[1]]))
                found[q] = self.paths[p].on(cell[p][q][0], audit, self.rows, p)
        self.paths, self.rows, self.kinds = found, [], []

    def report(self) -> dict:
        cell = parse(self.kinds)
        ends = [(path.cost + way[0], "".join([*path.audit, way[1]]), q) for p, path in self.paths.items() for q in ENDS if (way := cell[p][q])]
        cost, audit, end = min(ends)
        self.close([end])
        low, high, count = self.turns
        return {
            "conv_id": self.conv_id,
            "gaps": high - low + 1 - count if count else 0,
            "blank": self.blank,
            "duplicate": self.duplicate,
            "truncated": self.truncated,
            "illegal": self.illegal,
            "cost": cost,
            "audit": audit,
            "repaired_sha256": self.paths[end].digest.hexdigest(),
        }


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = "conv_id long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", audit string, repaired_sha256 string"
REPORT_ARROW = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in NUMBERS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def plain_rows(turns: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """(conv_id, turn, role, text) with one blank for null roles and texts."""
    some = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return turns.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), some(role).alias("role"), some(text).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``plain_rows``, damaged by the checksum of ``conv_id:turn``; dropped ones have a null role."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % DAMAGES
    text = F.when(damage == EMPTIED, "").when(damage == UNSTOPPED, F.regexp_replace("text", "[.!?]", "")).when(damage != DROPPED, F.col("text"))
    role = F.when(damage == MADE_USER, "user").when(damage != DROPPED, F.col("role"))
    times = F.when(damage == REPEATED, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Each conversation's rows on end in one partition: by turn, null first, then by role and text."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    ``rows`` are those of ``plain_rows`` or ``damaged``. Rows of one turn follow each other by role
    and text, so repeated rows are neighbours and all but the first are duplicates. Rows without
    conv_id are one conversation. Roles other than system, user and assistant count by their first
    letter; where that is none of s, u and a the row must be given another role or go. A conversation
    of dropped rows only has zeros, an empty audit and the digest of an empty text. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, []
        for batch in batches:
            for conv_id, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held.conv_id != conv_id:
                    if held is not None:
                        done.append(held.report())
                    held = Conversation(conv_id)
                if role is not None:
                    held.add(turn, role, text)
            yield pa.RecordBatch.from_pylist(done, REPORT_ARROW)
            done = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.report()], REPORT_ARROW)

    return in_order(rows.select("conv_id", "turn", "role", "text")).mapInArrow(run, REPORT)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the repaired conversations, a row for each turn that is left.

    ``edit`` is K (kept), R (given another role) or I (inserted, with an empty text and no turn);
    ``place`` counts from 0. The audits come first in the stream of rows that they tell about.
    """
    audits = repair(rows).select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = audits.union(rows.filter("role IS NOT NULL").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text"))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place = "", 0, START, 0
        for batch in batches:
            out = []

            def edited(conv_id: int | None, turn: int | None, rows: list[tuple[str, str]], edits: str) -> None:
                nonlocal state, place
                for edit, _, role, text in repaired(rows, edits, state):
                    if edit != "D":
                        out.append({"conv_id": conv_id, "place": place, "edit": edit, "turn": None if edit == "I" else turn, "role": role, "text": text})
                        place, state = place + 1, STEPS[state, role[:1]]

            for conv_id, kind, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    audit, at, state, place = text, 0, START, 0
                    first = len(audit) - len(audit.lstrip("I"))
                else:
                    first = 1
                    while at + first < len(audit) and audit[at + first] == "I":
                        first += 1
                edited(conv_id, turn, [(role, text)] if kind else [], audit[at : at + first])
                at += first
            yield pa.RecordBatch.from_pylist(out, schema)

    return stream.mapInArrow(run, "conv_id long, place long, edit string, turn long, role string, text string")
