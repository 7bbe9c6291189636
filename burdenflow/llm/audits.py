"""Least-cost repair of conversations, with an audit of the edits.

A conversation is well formed if the first letters of its roles read `(s?(ua)+)?`. An edit keeps a row (cost 0), makes
it a user's or an assistant's (1, letter R), deletes it (2) or inserts an empty user's or assistant's row (5). Rows
that say nothing or repeat an earlier row must be deleted; a row whose text breaks off costs 5 more unless deleted.
Of the cheapest repairs the one whose letters (D, I, K, R) come first in ASCII order is taken; the letters alone say
what was done, as in every state of the pattern only one role can be inserted or put in.

Rows are dealt out by ranges of conversation and turn, so a long conversation lies in several tasks, and are cut into
segments of a bounded size. A segment's result is, for each state that it may begin in and each that it may end in,
the cheapest audit. Results of one conversation's segments are then put together in order. Equal costs are told apart
by their audits: candidates share their beginnings as linked nodes with ancestors at all powers of two and rolling
hashes of the whole prefix, the longest common prefix is found by a search over its length, and is then compared
letter by letter wherever the nodes aren't the same, so equal hashes of unequal prefixes do no harm.

Nulls count as one space, also in the key of the damage. Rows of a conversation go by turn, nulls first, then by role
and text, and a repeated row stands beside its original. Repeated input rows are rows like any others. A null conv_id
is a conversation. An empty text is blank; an empty role has no first letter. A conversation without rows has zeros,
an empty audit and the hash of an empty string. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from burdenflow.llm.store import keep, width

#: A segment ends with so many rows or characters.
ROWS, CHARACTERS = 4096, 4_000_000
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
#: States of the pattern (0 nothing yet, 1 after s, 2 after u, 3 after a) by letter, the state and the
#: role of an inserted or renamed row, and the states in which a conversation may end.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
PUT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
FINAL = (0, 3)
#: Numbers of the rolling hash.
BASE, MODULUS = 911_382_323, (1 << 61) - 1


#: What is known of a conversation or of a part of it.
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PATH = ("begin", "end", "cost", "audit")
_TURNS = ("low", "high", "turns")
_PART = (
    "conv_id long, segment long, alone boolean, opens boolean, roles array<string>, texts array<string>, faults string, digests array<binary>, "
    + ", ".join(f"{n} long" for n in (*_TURNS, "illegal")) + ", gaps long, blank long, duplicate long, truncated long, cost long, audit string, repaired_sha256 string"
)
_PATHS = (
    "conv_id long, segment long, " + ", ".join(f"{n} long" for n in (*_TURNS, *_COUNTS))
    + ", first_role string, last_role string, paths array<struct<begin: int, end: int, cost: long, audit: string>>"
)
_JOINED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<segment: long, piece: string>>"
RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


class Audit:
    """Letters of edits: an earlier audit and a piece after it. Nodes are never changed, so audits share beginnings."""

    __slots__ = ("piece", "size", "code", "depth", "up")

    def __init__(self, earlier: "Audit | None", piece: str):
        self.piece = piece
        self.size, self.code, self.depth = (earlier.size, earlier.code, earlier.depth + 1) if earlier else (0, 0, 0)
        self.size, self.code = self.size + len(piece), rolled(self.code, piece)
        self.up: list[Audit] = []  # ancestors 1, 2, 4, ... nodes back
        while earlier is not None:
            self.up.append(earlier)
            level = len(self.up) - 1
            earlier = earlier.up[level] if len(earlier.up) > level else None

    def holding(self, size: int) -> "Audit":
        """The first node whose letters reach so far."""
        node = self
        while node.up and node.up[0].size >= size:
            node = next(up for up in reversed(node.up) if up.size >= size)
        return node

    def code_of(self, size: int) -> int:
        """Hash of the first letters."""
        node = self.holding(size)
        if node.size == size:
            return node.code
        earlier = node.up[0]
        return rolled(earlier.code, node.piece[: size - earlier.size])

    def back(self, nodes: int) -> "Audit":
        node = self
        while nodes:
            level = min(nodes.bit_length(), len(node.up)) - 1
            node, nodes = node.up[level], nodes - (1 << level)
        return node

    def pieces(self, until: "Audit | None" = None) -> list[str]:
        """Pieces after a node."""
        out, node = [], self
        while node is not None and node is not until:
            out.append(node.piece)
            node = node.up[0] if node.up else None
        return out[::-1]


def rolled(code: int, piece: str) -> int:
    for letter in piece:
        code = (code * BASE + ord(letter)) % MODULUS
    return code


def last_shared(a: Audit, b: Audit) -> Audit | None:
    """The last node that two audits share."""
    a, b = a.back(max(0, a.depth - b.depth)), b.back(max(0, b.depth - a.depth))
    while a is not b:
        if not a.up:
            return None
        level = next((j for j in range(len(a.up) - 1, -1, -1) if a.up[j] is not b.up[j]), 0)
        a, b = a.up[level], b.up[level]
    return a


def comes_before(a: Audit, b: Audit) -> bool:
    """Whether the letters of a come before those of b."""
    if a is b:
        return False
    shared = last_shared(a, b)
    low = start = shared.size if shared else 0
    high = min(a.size, b.size)
    while low < high:  # the longest common prefix, by its hashes
        middle = (low + high + 1) // 2
        if a.code_of(middle) == b.code_of(middle):
            low = middle
        else:
            high = middle - 1
    # equal hashes aren't proof, so letters after the shared node are compared as well
    mine, other = "".join(a.pieces(shared)), "".join(b.pieces(shared))
    same = low - start
    return mine < other if mine[:same] != other[:same] else mine[same : same + 1] < other[same : same + 1]


Front = list  # of the four states' (cost, audit) or None


def offer(front: Front, state: int, cost: int, audit: Audit, piece: str) -> bool:
    """Let a state have a path if that is better than the one it has."""
    known = front[state]
    if known is not None and known[0] < cost:
        return False
    new = Audit(audit, piece)
    if known is not None and known[0] == cost and not comes_before(new, known[1]):
        return False
    front[state] = (cost, new)
    return True


def with_inserts(front: Front) -> Front:
    changed = True
    while changed:
        changed = False
        for state in sorted((s for s in range(4) if front[s]), key=lambda s: front[s][0]):
            cost, audit = front[state]
            changed |= offer(front, PUT[state][0], cost + INSERT, audit, "I")
    return front


def after_row(front: Front, letter: str, fault: str) -> Front:
    """The best paths once a row has been dealt with."""
    out: Front = [None] * 4
    for state, path in enumerate(front):
        if path is None:
            continue
        cost, audit = path
        offer(out, state, cost + DELETE, audit, "D")
        if fault in "bd":
            continue
        extra = BROKEN if fault == "t" else 0
        if letter in STEPS[state]:
            offer(out, STEPS[state][letter], cost + KEEP + extra, audit, "K")
        offer(out, PUT[state][0], cost + REROLE + extra, audit, "R")
    return with_inserts(out)


def started(state: int) -> Front:
    front: Front = [None] * 4
    front[state] = (0, Audit(None, ""))
    return with_inserts(front)


def segment_paths(letters: list[str], faults: str, begins: range | tuple[int, ...]) -> list[tuple[int, int, int, str]]:
    """begin, end, cost and audit of the cheapest path between every two states."""
    out = []
    for begin in begins:
        front = started(begin)
        for letter, fault in zip(letters, faults):
            front = after_row(front, letter, fault)
        out += [(begin, end, path[0], "".join(path[1].pieces())) for end, path in enumerate(front) if path]
    return out


def joined(front: Front, paths: list[tuple[int, int, int, str]]) -> Front:
    """The best paths once a segment has been dealt with."""
    out: Front = [None] * 4
    for begin, end, cost, audit in paths:
        if front[begin]:
            offer(out, end, front[begin][0] + cost, front[begin][1], audit)
    return out


def finished(front: Front) -> tuple[int, Audit]:
    best: Front = [None]
    for state in FINAL:
        if front[state]:
            offer(best, 0, *front[state], "")
    return best[0]


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> tuple[list[str], int]:
    """Lines of the repaired rows, and the state after them."""
    lines, at = [], 0
    for edit in audit:
        if edit == "I":
            state, role = PUT[state]
            lines.append(f"{role}:")
            continue
        if edit == "K":
            state = STEPS[state][roles[at][:1]]
            lines.append(f"{roles[at]}:{texts[at]}")
        elif edit == "R":
            state, role = PUT[state]
            lines.append(f"{role}:{texts[at]}")
        at += 1
    return lines, state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `dropped`; a dropped row stays, so that its conversation does."""
    blank = F.lit(" ")
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), blank)
    hit = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    copies = F.explode(F.sequence(F.lit(0), F.when(hit == 3, 1).otherwise(0)))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, F.lit("user")).otherwise(text_of("role")).alias("role"), text.alias("text"), (hit == 0).alias("dropped"), copies.alias("copy"),
    ).drop("copy")


_SPACE = " \t\n\x0b\x0c\r"


class Segment:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv_id: int | None, opens: bool):
        self.conv_id, self.opens = conv_id, opens
        self.roles, self.texts, self.faults, self.digests, self.turns, self.size = [], [], [], [], [], 0
        self.seen: set[bytes] = set()

    def add(self, turn: int | None, role: str, text: str) -> None:
        core, digest = text.strip(_SPACE), None
        if not core:
            fault = "b"
        else:
            digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            fault = "d" if digest in self.seen else "" if core[-1] in ".!?" else "t"
            self.seen.add(digest)
        self.faults.append(fault or ".")
        self.digests.append(None if fault == "d" else digest)
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.size += len(role) + len(text)

    def full(self, most: int) -> bool:
        return len(self.roles) >= most or self.size >= CHARACTERS

    def row(self, segment: int, closes: bool) -> dict:
        known = [t for t in self.turns if t is not None]
        row = {
            "conv_id": self.conv_id, "segment": segment, "alone": self.opens and closes, "opens": self.opens,
            "low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known)), "illegal": illegal(self.roles),
        }
        faults = "".join(self.faults)
        if not row["alone"]:
            return row | {"roles": self.roles, "texts": self.texts, "faults": faults, "digests": self.digests}
        cost, audit = finished(joined([(0, Audit(None, "")), None, None, None], segment_paths([r[:1] for r in self.roles], faults, (0,))))
        audit = "".join(audit.pieces())
        lines, _ = repaired(self.roles, self.texts, audit, 0)
        return row | counts(faults) | {
            "gaps": known[-1] - known[0] + 1 - row["turns"] if known else 0, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }


def counts(faults: str) -> dict[str, int]:
    return {"blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t")}


def illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def map_rows(df: DataFrame, function: Callable[[Iterator[dict]], Iterator[dict]], schema: str, at_a_time: int) -> DataFrame:
    """A partition's rows, in their order, through a function; so many of them are held at a time."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in function(_rows(batches, at_a_time)):
            held.append(row)
            if len(held) >= at_a_time:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)

    return df.mapInArrow(run, schema)


def _rows(batches: Iterator[pa.RecordBatch], at_a_time: int) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, at_a_time):
            yield from batch.slice(at, at_a_time).to_pylist()


def _segments(rows: Iterator[dict], most: int) -> Iterator[dict]:
    number, held = TaskContext.get().partitionId() << 32, None
    for row in rows:
        if held is None:
            held = Segment(row["conv_id"], False)  # the conversation may begin in an earlier task
        elif row["conv_id"] != held.conv_id:
            yield held.row(number, True)
            number, held = number + 1, Segment(row["conv_id"], True)
        elif held.full(most):
            yield held.row(number, False)
            number, held = number + 1, Segment(row["conv_id"], False)
        if not row["dropped"]:
            held.add(row["turn"], row["role"], row["text"])
    if held is not None:
        yield held.row(number, False)  # it may go on in a later task


def _with_repeats(parts: DataFrame) -> DataFrame:
    """`seen`: digests of a segment that an earlier one of its conversation has."""
    held = parts.select("conv_id", "segment", F.explode("digests").alias("digest")).filter("digest is not null")
    first = held.groupBy("conv_id", "digest").agg(F.min("segment").alias("first"))
    first = first.select(F.col("conv_id").alias("other_id"), F.col("digest").alias("other_digest"), "first")
    later = held.join(first, F.col("conv_id").eqNullSafe(F.col("other_id")) & (F.col("digest") == F.col("other_digest"))).filter("segment > first")
    seen = later.groupBy("segment").agg(F.collect_set("digest").alias("seen"))
    return parts.drop("texts").join(seen, "segment", "left")


def _paths(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        seen = set(row["seen"] or ())
        faults = "".join("d" if d in seen else f for f, d in zip(row["faults"], row["digests"]))
        paths = segment_paths([r[:1] for r in row["roles"]], faults, (0,) if row["opens"] else range(4))
        yield {n: row[n] for n in ("conv_id", "segment", *_TURNS, "illegal")} | counts(faults) | {
            "first_role": row["roles"][0][:1] if row["roles"] else None, "last_role": row["roles"][-1][:1] if row["roles"] else None,
            "paths": [dict(zip(_PATH, p)) for p in paths],
        }


class Conversation:
    """Segments that follow each other, put together."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.front, self.segments = conv_id, [(0, Audit(None, "")), None, None, None], []
        self.low = self.high = self.last_role = None
        self.turns, self.counts = 0, dict.fromkeys(_COUNTS, 0)

    def add(self, row: dict) -> None:
        self.front = joined(self.front, [tuple(p[n] for n in _PATH) for p in row["paths"]])
        self.segments.append(row["segment"])
        for name in _COUNTS:
            self.counts[name] += row[name]
        if row["first_role"] is not None:
            if self.last_role is not None:
                self.counts["illegal"] += illegal([self.last_role, row["first_role"]])
            self.last_role = row["last_role"]
        if row["turns"]:
            self.turns += row["turns"] - (row["low"] == self.high)
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]

    def row(self) -> dict:
        cost, audit = finished(self.front)
        pieces = audit.pieces()[1:-1]  # between an empty first node and an empty last one, a piece for each segment
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, "cost": cost, "audit": "".join(pieces)} | self.counts | {
            "pieces": [{"segment": n, "piece": p} for n, p in zip(self.segments, pieces, strict=True)],
        }


def _conversations(rows: Iterator[dict]) -> Iterator[dict]:
    for conv_id, own in groupby(rows, lambda row: row["conv_id"]):
        held = Conversation(conv_id)
        for row in own:
            held.add(row)
        yield held.row()


def _hashes(rows: Iterator[dict]) -> Iterator[dict]:
    """Hash of the repaired rows of each conversation, whose segments follow each other."""
    for conv_id, own in groupby(rows, lambda row: row["conv_id"]):
        total, state, begun = hashlib.sha256(), 0, False
        for row in own:
            lines, state = repaired(row["roles"], row["texts"], row["piece"], state)
            for line in lines:
                total.update((f"\n{line}" if begun else line).encode())
                begun = True
        yield {"hashed_id": conv_id, "repaired_sha256": total.hexdigest()}


def repair_audits(conversations: DataFrame, damage: bool = True, rows: int = ROWS) -> DataFrame:
    """One row for each conversation: faults, the cost and audit of its cheapest repair, and the hash of the result."""
    parts = width(conversations.sparkSession)
    ordered = (damaged if damage else undamaged)(conversations)
    ordered = ordered.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 16))
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text")
    kept = keep(map_rows(ordered, partial(_segments, most=rows), _PART, 256), "conversation-segments")
    whole, cut = kept.filter("alone").select(*RESULT), kept.filter("not alone")
    by_conversation = lambda df: df.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "segment")
    paths = map_rows(_with_repeats(cut), _paths, _PATHS, 8)
    found = keep(map_rows(by_conversation(paths), _conversations, _JOINED, 8), "conversation-audits")
    texts = cut.select("conv_id", "segment", "roles", "texts").join(found.select(F.inline("pieces")), "segment")
    hashes = map_rows(by_conversation(texts), _hashes, "hashed_id long, repaired_sha256 string", 8)
    spanning = found.drop("pieces").join(hashes, F.col("conv_id").eqNullSafe(F.col("hashed_id"))).select(*RESULT)
    return whole.unionByName(spanning)


def undamaged(conversations: DataFrame) -> DataFrame:
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    ids = [F.col(n).cast("long").alias(n) for n in ("conv_id", "turn")]
    return conversations.select(*ids, text_of("role"), text_of("text"), F.lit(False).alias("dropped"))
