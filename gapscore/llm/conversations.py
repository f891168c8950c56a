"""Conversations put right: the cheapest edits that give each a proper order of turns, with an audit of the edits."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gapscore.llm.trails import Trails
from gapscore.llm.work import Scratch
from gapscore.storage import small_side

#: Rows, and characters of text, of a part of a long conversation.
PART_ROWS = 4096
PART_CHARS = 4_000_000

SPACES = " \t\n\x0b\x0c\r"
_REROLE, _DELETE, _INSERT, _CUT_OFF = 3, 4, 3, 3
# What the roles so far are: nothing, a system turn, up to a user's turn, up to an assistant's turn.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_PROPER = (_START, _ASSISTANT)
_KEPT = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
_LEGAL = {"su", "ua", "au"}

#: (initial of the role, whether the row must go, what it costs to leave it in)
Row = tuple[str, bool, int]
Best = list[tuple[int, int] | None]


def _spoken(state: int) -> tuple[str, int]:
    """The role that may be put in next, and the state after it."""
    return ("assistant", _ASSISTANT) if state == _USER else ("user", _USER)


def _offer(trails: Trails, best: Best, state: int, cost: int, parent: int, label: str) -> None:
    held = best[state]
    if held is None or cost < held[0]:
        best[state] = (cost, trails.add(parent, label))
    elif cost == held[0] and trails.less(node := trails.add(parent, label), held[1]):
        best[state] = (cost, node)


def _insert(trails: Trails, best: Best) -> None:
    # a user's turn first: two turns put in lead from one user's turn to another only at a cost
    for state in (_START, _SYSTEM, _ASSISTANT, _USER):
        if best[state] is not None:
            _offer(trails, best, _spoken(state)[1], best[state][0] + _INSERT, best[state][1], "I")


def audits(rows: Iterable[Row], start: int = _START) -> list[tuple[int, str] | None]:
    """For each state after the rows: the least cost from ``start``, and the first audit of that cost.

    The best edits up to a row are a node of ``Trails``, so that all states share their beginnings. Two audits of
    equal cost up to the same row and state never begin with each other, because the longer one would have
    more turns put in, so the first of them stays first whatever follows.
    """
    trails = Trails()
    best: Best = [None] * 4
    best[start] = (0, 0)
    _insert(trails, best)
    for initial, must_go, left in rows:
        after: Best = [None] * 4
        for state, held in enumerate(best):
            if held is None:
                continue
            cost, node = held
            _offer(trails, after, state, cost + _DELETE, node, "D")
            if not must_go:
                kept = _KEPT.get(initial, {}).get(state)
                if kept is not None:
                    _offer(trails, after, kept, cost + left, node, "K")
                _offer(trails, after, _spoken(state)[1], cost + _REROLE + left, node, "R")
        _insert(trails, after)
        best = after
    return [held and (held[0], trails.text(held[1])) for held in best]


def _first(found: list[tuple[int, str] | None]) -> tuple[int, str]:
    return min(found[state] for state in _PROPER if found[state] is not None)


@functools.lru_cache(maxsize=50_000)
def _whole(rows: tuple[Row, ...]) -> tuple[int, str]:
    return _first(audits(rows))


class Repair:
    """Applies an audit to the rows of a conversation, part by part, and hashes the repaired text."""

    def __init__(self):
        self.state, self.hash, self.empty = _START, hashlib.sha256(), True

    def _say(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def feed(self, letters: Iterator[str], rows: Iterator[tuple[str, str]], n_rows: int) -> None:
        """Reads letters until ``n_rows`` rows are used; without rows, until the end."""
        while n_rows:
            letter = next(letters)
            if letter == "I":
                role, self.state = _spoken(self.state)
                self._say(role, "")
                continue
            role, text = next(rows)
            n_rows -= 1
            if letter == "K":
                self.state = _KEPT[role[0]][self.state]
                self._say(role, text)
            elif letter == "R":
                role, self.state = _spoken(self.state)
                self._say(role, text)

    def end(self, letters: Iterator[str]) -> str:
        for _ in letters:  # turns put in after the last row
            role, self.state = _spoken(self.state)
            self._say(role, "")
        return self.hash.hexdigest()


class Part:
    """Successive rows of one conversation: what is counted of them, and their roles and texts."""

    def __init__(self):
        self.rows: list[Row] = []
        self.said: list[tuple[str, str]] = []
        self.chars = self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        initial = role[:1]
        if self.rows:
            self.illegal += self.last_role + initial not in _LEGAL
        else:
            self.first_role = initial
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        end = text.rstrip(SPACES)[-1:]
        blank, cut_off = not end, end not in ".!?"
        self.blank += blank
        self.duplicate += seen and not blank
        must_go = seen or blank
        self.truncated += cut_off and not must_go
        self.rows.append((initial, must_go, _CUT_OFF if cut_off and not must_go else 0))
        self.said.append(("", "") if must_go else (role, text))
        self.chars += 0 if must_go else len(text)

    def full(self, rows: int) -> bool:
        return len(self.rows) >= rows or self.chars >= PART_CHARS


_COUNTED = ("blank", "duplicate", "truncated", "illegal")
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_EDGES = "n_turns long, first_turn long, last_turn long, first_role string, last_role string"
_PATHS = "states array<int>, costs array<long>, audits array<string>"
_SAID = "roles array<string>, texts array<string>"


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _gaps(first: int | None, last: int | None, n_turns: int) -> int:
    return 0 if first is None else last - first + 1 - n_turns


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, length = [], 0
    for row in rows:
        held.append(row)
        length += row.pop("chars", 0)
        if len(held) >= size or length >= chars:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, length = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


_NONE = object()


def _parts(schema: pa.Schema, part_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows to conversations, or to parts of those that may go on in another task or are long.

    The first and the last conversation of a task may go on in its neighbours, so they are given as parts.
    """

    def whole(conv: object, part: Part) -> dict:
        cost, audit = _whole(tuple(part.rows))
        repair, letters = Repair(), iter(audit)
        repair.feed(letters, iter(part.said), len(part.said))
        return {
            "conv_id": conv,
            "gaps": _gaps(part.first_turn, part.last_turn, part.n_turns),
            **{name: getattr(part, name) for name in _COUNTED},
            "cost": cost,
            "audit": audit,
            "repaired_sha256": repair.end(letters),
        }

    def as_row(conv: object, part: Part, number: int, no: int) -> dict:
        paths = []
        if part.rows:
            paths = [(4 * start + end, *path) for start in range(4) for end, path in enumerate(audits(part.rows, start)) if path]
        states, costs, letters = zip(*paths) if paths else ((), (), ())
        roles, texts = zip(*part.said) if part.said else ((), ())
        return {
            "conv_id": conv,
            "task": number,
            "no": no,
            **{name: getattr(part, name) for name in (*_COUNTED, *_names(_EDGES))},
            **{"states": states, "costs": costs, "audits": letters, "roles": roles, "texts": texts, "chars": part.chars},
        }

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()

        def rows() -> Iterator[dict]:
            conv, part, no, first = _NONE, Part(), 0, True
            for conv_id, turn, role, text, n, seen in _rows(batches):
                if conv is _NONE:
                    conv = conv_id
                elif conv_id != conv:
                    yield as_row(conv, part, number, no) if first or no else whole(conv, part)
                    conv, part, no, first = conv_id, Part(), 0, False
                for copy in range(n):
                    if part.full(part_rows):
                        yield as_row(conv, part, number, no)
                        part, no = Part(), no + 1
                    part.add(turn, role, text, seen or copy > 0)
            if conv is not _NONE:
                yield as_row(conv, part, number, no)

        yield from _batches(rows(), schema)

    return parts


def _composed(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The counts, the least cost and the first audit of conversations in parts, which come in order."""

    def result(conv: object, total: Part, trails: Trails, best: Best) -> dict:
        cost, audit = _first([held and (held[0], trails.text(held[1])) for held in best])
        return {
            "conv_id": conv,
            "gaps": _gaps(total.first_turn, total.last_turn, total.n_turns),
            **{name: getattr(total, name) for name in _COUNTED},
            "cost": cost,
            "audit": audit,
        }

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            conv, total, trails, best = _NONE, Part(), Trails(), []
            for conv_id, *counts, n_turns, first, last, first_role, last_role, states, costs, texts in _rows(batches):
                if conv is _NONE or conv_id != conv:
                    if conv is not _NONE:
                        yield result(conv, total, trails, best)
                    conv, total, trails, best = conv_id, Part(), Trails(), [(0, 0), None, None, None]
                if not states:
                    continue  # no row is left after damage
                for name, count in zip(_COUNTED, counts):
                    setattr(total, name, getattr(total, name) + count)
                total.illegal += total.last_role is not None and total.last_role + first_role not in _LEGAL
                total.last_role = last_role
                if first is not None:
                    total.n_turns += n_turns - (first == total.last_turn)
                    total.first_turn = first if total.first_turn is None else total.first_turn
                    total.last_turn = last
                after: Best = [None] * 4
                for path, cost, letters in zip(states, costs, texts):
                    start, end = divmod(path, 4)
                    if best[start] is not None:
                        _offer(trails, after, end, best[start][0] + cost, best[start][1], letters)
                best = after
            if conv is not _NONE:
                yield result(conv, total, trails, best)

        yield from _batches(rows(), schema, size=200)

    return compose


def _repaired(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes conversations in parts: a row with the audit comes first, then the parts in order."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            head, repair, letters = None, Repair(), iter("")
            for *result, audit, roles, texts in _rows(batches):
                if audit is None:
                    repair.feed(letters, zip(roles, texts), len(roles))
                    continue
                if head:
                    yield head | {"repaired_sha256": repair.end(letters)}
                head = dict(zip(["conv_id", *_names(_RESULT)], [*result, audit]))
                repair, letters = Repair(), iter(audit)
            if head:
                yield head | {"repaired_sha256": repair.end(letters)}

        yield from _batches(rows(), schema, size=200)

    return apply


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): equal rows together, damaged as the CRC-32 of ``conv_id:turn`` says.

    A row that is dropped leaves an empty one with n = 0, so that its conversation stays.
    """
    or_space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    text = (
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    )
    after = own.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("n"),
    )
    return after.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def repaired_conversations(rows: DataFrame, with_damage: bool = True, part_rows: int = PART_ROWS) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role and text. They are sorted over all tasks by conversation and turn, so that a long
    conversation lies in several tasks. A conversation that lies inside a task is repaired there. For the first and the
    last of each task, and for long ones, the costs and audits from every state to every state are found for
    each part, composed, and applied to the parts in order; only the audit is held whole, as it is one value of the result.

    Defined cases: rows of one turn come in the order of role, then of the text's first 32 characters and its hash;
    a null turn comes first and counts in no gap; a null role or text is one space, so the row is blank or has no proper
    role; a null conv_id is a conversation; repeated rows are duplicates; long texts are hashed in pieces; a
    conversation without a row after damage has zeros and an empty audit; other columns are ignored; an empty table
    gives no rows. ``with_damage`` false takes the rows as they are.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    if with_damage:
        base = damaged(rows)
    else:
        filled = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
        base = filled.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    base = scratch.keep(base, "rows")
    digest = F.sha2(F.col("text"), 256)
    said = base.where("n > 0").groupBy("conv_id", "role", digest.alias("digest"))
    again = said.agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first")).where("n > 1")
    again = scratch.keep(again.select(F.col("conv_id").alias("conv"), F.col("role").alias("said_by"), "digest", "first"), "again")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("role") == F.col("said_by")) & (digest == F.col("digest"))
    marked = base.join(small_side(again), same, "left")
    seen = F.coalesce(~F.col("turn").eqNullSafe(F.col("first.turn")), F.lit(False)) & F.col("first").isNotNull()
    order = ["conv_id", "turn", "role", "head", "tail"]
    keyed = marked.select("conv_id", "turn", "role", "text", "n", seen.alias("seen"), F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("tail"))
    inputs = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("head", "tail")

    conv = f"conv_id {base.schema['conv_id'].dataType.simpleString()}"
    types, result = f"{conv}, {_RESULT}, task int, no int, {_EDGES}, {_PATHS}, {_SAID}", f"{conv}, {_RESULT}"
    done = scratch.keep(inputs.mapInArrow(_parts(_arrow(types), part_rows), types), "parts")
    parts, by_place = done.where("task IS NOT NULL"), ["conv_id", "task", "no"]

    counted = parts.select("conv_id", *_COUNTED, *_names(_EDGES), *_names(_PATHS), "task", "no")
    counted = counted.repartition("conv_id").sortWithinPartitions(*by_place).drop("task", "no")
    heads = counted.mapInArrow(_composed(_arrow(result)), result).drop("repaired_sha256")
    empty = lambda ddl: [F.lit(None).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in ddl.split(", "))]
    heads = heads.select("*", *empty(_SAID), F.lit(-1).alias("task"), F.lit(-1).alias("no"))
    said = parts.select("conv_id", *empty(_RESULT), *_names(_SAID), "task", "no").drop("repaired_sha256")
    streams = heads.unionByName(said).repartition("conv_id").sortWithinPartitions(*by_place).drop("task", "no")
    crossing = streams.mapInArrow(_repaired(_arrow(result)), result)
    return done.where("task IS NULL").select("conv_id", *_names(_RESULT)).unionByName(crossing)
