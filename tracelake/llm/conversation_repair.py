"""Conversation structure repair: the cheapest edits after which roles read as an optional system turn and pairs of user and assistant.

Edits: Keep (0), Rerole to user or assistant (1), Delete (2; rows that are blank or repeated must go), Insert an empty turn (5); a
truncated row that stays adds 5. A cost DP runs back over (place, state) nodes, the state being what was read last: nothing,
system, user or assistant. An arc is optimal if its cost and its target's make up the node's. The roles that R and I set follow
from the state, so no two optimal arcs of a node carry the same letter. Paths are then ranked by prefix doubling: a node's rank
by the first letter of its least audit, then by its first 2, 4, 8, ... letters, as the pair of its own rank and that of the node
to which the doubled pointer leads. Ranks choose the arc, and the doubled pointers give the node at every step of the least
path without walking it. All conversations of a block go through these steps together, as NumPy arrays.

Rows are dealt by ranges of (conversation, turn, role, start of the text) and sorted, so a conversation of any length is spread
over as many tasks as its rows need. A conversation that lies inside one task is repaired there. The first and the last one of
a task may go on in the next: their rows are written, and each task's fragment gives, for each state at its start and end, the
least cost and audit; fragments are folded in order, one row each. No task holds more rows than its range. The hash of a
repaired conversation is by its definition one pass over its text; for conversations of many fragments it is taken from a
stream of their rows.

Null roles and texts are read as one space. Null turns come first; rows of one turn are ordered by role and text, so repeated
rows are adjacent. A null conversation id is one conversation. Role initials are first characters; an empty role has none, and
such roles, as any but s, u and a, can't be kept. Columns besides the four named ones are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import SPACE_CHARS, stored

COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_OTHER, _DEAD, _FAR = 3, 4, 1 << 40
_INITIALS = {"s": 0, "u": 1, "a": 2}
#: by initial and state: the state after a kept row
_KEPT = np.array([[SYSTEM, _DEAD, _DEAD, _DEAD], [USER, USER, _DEAD, USER], [_DEAD, _DEAD, ASSISTANT, _DEAD], [_DEAD] * 4])
#: by state: the state after a row that is given a role, or inserted
_GIVEN = np.array([USER, USER, ASSISTANT, USER])
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
_DELETE, _INSERT, _KEEP, _REROLE = 1, 2, 3, 4
_ENDS = np.array([[0, _FAR, _FAR, 0]])
BLOCK_ROWS, START_CHARS = 20_000, 32


class LeastPaths:
    """The least cheapest audits of many row sequences at once.

    ``letter``, ``must`` (be deleted) and ``late`` (truncated) by row; ``off``: where each sequence starts, and the end.
    ``ends``: the cost of ending in each state, by sequence; ``trailing``: whether rows may be inserted after the last.
    """

    def __init__(self, letter, must, late, off, ends, trailing):
        n, size = len(letter), np.diff(off)
        self.base = off[:-1] + np.arange(len(size))
        stay = np.where(must, _FAR, COST_TRUNCATED * late.astype(np.int64))[:, None]
        cost = np.full((n + len(size), 5), _FAR)
        cost[self.base + size, :4] = self._inserted(ends) if trailing else ends
        longest = np.argsort(-size, kind="stable")
        active = np.searchsorted(-size[longest], -np.arange(size.max(initial=0)), side="left")
        for i in range(size.max(initial=0) - 1, -1, -1):
            here = longest[: active[i]]
            row, place = off[here] + i, self.base[here] + i
            after = cost[place + 1]
            kept = stay[row] + np.take_along_axis(after, _KEPT[letter[row]], 1)
            best = np.minimum(np.minimum(COST_DELETE + after[:, :4], kept), COST_REROLE + stay[row] + after[:, _GIVEN])
            cost[place, :4] = self._inserted(best)
        self.cost = cost
        self._rank(letter, stay, np.arange(n) + np.repeat(np.arange(len(size)), size), self.base + size if trailing else self.base[:0])

    @staticmethod
    def _inserted(best):
        for _ in range(3):
            best = np.minimum(best, COST_INSERT + best[:, _GIVEN])
        return np.minimum(best, _FAR)

    def _rank(self, letter, stay, places, last):
        """Arcs of least cost by place, state and letter; ranks and pointers by doubling."""
        here, after = self.cost[places, :4], self.cost[places + 1]
        state = np.arange(4)[None, :]
        node = np.arange(len(self.cost) * 4).reshape(-1, 4)
        arcs = {_DELETE: (places, here == COST_DELETE + after[:, :4], node[places + 1])}
        every = np.concatenate([places, last])
        arcs[_INSERT] = (every, self.cost[every, :4] == COST_INSERT + self.cost[every][:, _GIVEN], node[every][:, _GIVEN])
        kept = _KEPT[letter]
        arcs[_KEEP] = (places, (kept != _DEAD) & (here == stay + np.take_along_axis(after, kept, 1)), np.take_along_axis(node[places + 1], np.where(kept == _DEAD, 0, kept), 1))
        arcs[_REROLE] = (places, here == COST_REROLE + stay + after[:, _GIVEN], node[places + 1][:, _GIVEN] + 0 * state)
        #: by letter and node: where the arc leads, or -1
        target = np.full((5, node.size), -1)
        for k, (at, optimal, to) in arcs.items():
            target[k][node[at].ravel()] = np.where(optimal & (self.cost[at, :4] < _FAR), to, -1).ravel()

        def least(rank):
            """The arc of the least letter, then of the least ranked target."""
            key = np.where(target >= 0, np.arange(5)[:, None] * (rank.max(initial=0) + 1) + rank[target], 1 << 62)
            code = np.where((target < 0).all(axis=0), 0, key.argmin(axis=0))
            return code, np.where(code == 0, np.arange(node.size), target[code, np.arange(node.size)])

        self.code, pointer = least(np.zeros(node.size, np.int64))
        rank, self.steps, self.pointers = self.code.astype(np.int64), (self.code > 0).astype(np.int64), [pointer]
        while (self.code[pointer] > 0).any():
            rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1].reshape(-1)
            self.steps = self.steps + self.steps[pointer]
            pointer = pointer[pointer]
            self.pointers.append(pointer)
        self.code, self.pointers[0] = least(rank)

    def path(self, sequences, states):
        """For each (sequence, state at its start): where its steps begin, and the code and node of each step."""
        first = self.base[sequences] * 4 + states
        steps = self.steps[first]
        begin = np.concatenate([[0], np.cumsum(steps)])
        t = np.arange(begin[-1]) - np.repeat(begin[:-1], steps)
        at = np.repeat(first, steps)
        for k, pointer in enumerate(self.pointers):
            at = np.where((t >> k) & 1, pointer[at], at)
        return begin, self.code[at], at


def _measured(roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(initial, whether blank, whether truncated) by row."""
    ends = [t.rstrip(SPACE_CHARS)[-1:] for t in texts]
    letter = np.array([_INITIALS.get(r[:1], _OTHER) for r in roles], np.int64)
    return letter, np.array([not e for e in ends], bool), np.array([bool(e) and e not in ".!?" for e in ends], bool)


def _illegal(letter: np.ndarray, off: np.ndarray) -> np.ndarray:
    """By sequence: neighbours whose initials aren't su, ua or au."""
    legal = np.zeros((4, 4), bool)
    legal[tuple(zip(*_LEGAL))] = True
    bad = np.zeros(len(letter) + 1, np.int64)
    bad[1:-1] = ~legal[letter[:-1], letter[1:]]
    bad[off[1:-1]] = 0
    total = np.cumsum(bad)
    return total[off[1:] - 1] - total[off[:-1]] if len(letter) else np.zeros(len(off) - 1, np.int64)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "part", "k", "turn", "role", "text"]


def _repair(conversations: list[list[tuple]]) -> list[tuple]:
    """For each conversation, rows of (turn, role, text): (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)."""
    rows = [x for c in conversations for x in c]
    off = np.concatenate([[0], np.cumsum([len(c) for c in conversations])]).astype(np.int64)
    roles, texts = [x[1] for x in rows], [x[2] for x in rows]
    letter, blank, late = _measured(roles, texts)
    again = np.zeros(len(rows), bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        seen: set[tuple[str, str]] = set()
        for i in range(a, b):
            pair = (roles[i], texts[i])
            again[i] = pair in seen
            seen.add(pair)
    again &= ~blank
    late &= ~again
    paths = LeastPaths(letter, blank | again, late, off, _ENDS.repeat(len(conversations), 0), True)
    begin, code, node = paths.path(np.arange(len(conversations)), np.zeros(len(conversations), np.int64))
    row, given = (node // 4 - np.repeat(np.arange(len(conversations)), np.diff(begin))).tolist(), _GIVEN[node % 4].tolist()
    audits, codes = _LETTERS[code].tobytes().decode(), code.tolist()
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off]).tolist()
    out = []
    faults = zip(count(blank), count(again), count(late), _illegal(letter, off).tolist())
    for c, fault in enumerate(faults):
        said = []
        for k in range(begin[c], begin[c + 1]):
            if codes[k] == _KEEP:
                said.append(f"{roles[row[k]]}:{texts[row[k]]}")
            elif codes[k] != _DELETE:
                said.append(f"{_ROLES[given[k]]}:{texts[row[k]] if codes[k] == _REROLE else ''}")
        turns = {x[0] for x in conversations[c]} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((gaps, *fault, int(paths.cost[paths.base[c], NOTHING]), audits[begin[c] : begin[c + 1]], hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order: results of the conversations inside the task, and the rows of its first and last one."""
    part, ids, pending = TaskContext.get().partitionId(), None, []
    types = [None, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], ids if k == 0 else t) for k, t in enumerate(types)], names=_NAMES)

    def results() -> pa.RecordBatch:
        found = [(c, *r, None, None, None, None, None) for (c, _), r in zip(pending, _repair([rows for _, rows in pending]))]
        pending.clear()
        return batch_of(found)

    edge = lambda c, k, row: (c, *[None] * 8, part, k, *row)
    none = object()
    first, here, rows, held, k, start = none, none, [], 0, 0, 0
    for batch in batches:
        ids = batch.schema.field(0).type
        edges = []
        for c, *row in zip(*[col.to_pylist() for col in batch.columns]):
            if first is none:
                first = here = c
            if c != here:
                if here != first:
                    pending.append((here, rows))
                    held += len(rows)
                here, rows, start = c, [], k
            if c == first:
                edges.append(edge(c, k, row))
            else:
                rows.append(row)
            k += 1
        for a in range(0, len(edges), 10_000):
            yield batch_of(edges[a : a + 10_000])
        if held >= BLOCK_ROWS:
            yield results()
            held = 0
    if pending:
        yield results()
    for a in range(0, len(rows), 10_000):
        yield batch_of([edge(here, start + a + j, x) for j, x in enumerate(rows[a : a + 10_000])])


_FRAGMENT = "blank long, duplicate long, truncated long, illegal long, first int, last int, costs array<long>, audits array<string>"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (part, conv_id, k, initial, blank, late, again) in order: for each fragment the least cost and audit by states at its start and end."""
    key, held, ids = None, [], None

    def done() -> pa.RecordBatch:
        letter, blank, late, again = (np.concatenate([x[j] for x in held]) for j in range(4))
        must, late = blank | again, late & ~again
        n, off = len(letter), np.array([0, len(letter)])
        four = LeastPaths(np.tile(letter, 4), np.tile(must, 4), np.tile(late, 4), np.arange(5) * n, np.where(np.eye(4, dtype=bool), 0, _FAR), False)
        at, state = np.repeat(np.arange(4), 4), np.tile(np.arange(4), 4)
        begin, code, _ = four.path(at, state)
        audits = _LETTERS[code].tobytes().decode()
        row = [key[0], key[1], int(blank.sum()), int(again.sum()), int(late.sum()), int(_illegal(letter, off)[0]), int(letter[0]), int(letter[-1]), four.cost[four.base[at], state].tolist(), [audits[a:b] for a, b in zip(begin[:-1], begin[1:])]]
        types = [pa.int32(), ids, *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["part", "conv_id", "blank", "duplicate", "truncated", "illegal", "first", "last", "costs", "audits"])

    for batch in batches:
        ids = batch.schema.field(1).type
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        columns = [np.asarray(batch.column(k).to_pylist(), t) for k, t in ((3, np.int64), (4, bool), (5, bool), (6, bool))]
        a = 0
        while a < len(keys):
            b = a + 1
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            if keys[a] != key and held:
                yield done()
                held = []
            key = keys[a]
            held.append([c[a:b] for c in columns])
            a = b
    if held:
        yield done()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From fragments in order of (conv_id, part): one row for each conversation."""
    none = object()
    here, ids, total, best, last = none, None, [], {}, None

    def done() -> pa.RecordBatch:
        closed = {NOTHING: (0, ""), ASSISTANT: (0, ""), USER: (COST_INSERT, "I"), SYSTEM: (2 * COST_INSERT, "II")}
        cost, audit = min((c + closed[s][0], a + closed[s][1]) for s, (c, a) in best.items())
        types = [ids, *[pa.int64()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([here, *total, cost, audit], types)], names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    for batch in batches:
        ids = batch.schema.field(0).type
        for c, _, *counts, first, final, costs, audits in zip(*[x.to_pylist() for x in batch.columns]):
            if c != here:
                if here is not none:
                    yield done()
                here, total, best, last = c, [0] * 4, {NOTHING: (0, "")}, None
            total = [x + y for x, y in zip(total, counts)]
            total[3] += last is not None and (last, first) not in _LEGAL
            last, step = final, {}
            for end in range(4):
                ways = [(cost + costs[4 * end + s], audit + audits[4 * end + s]) for s, (cost, audit) in best.items() if costs[4 * end + s] < _FAR]
                if ways:
                    step[end] = min(ways)
            best = step
    if here is not none:
        yield done()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each conversation's audit (part null) and then its rows in order: the hash of what the edits leave."""
    none = object()
    here, ids, audit, at, state, hashed, any_ = none, None, "", 0, NOTHING, None, False

    def say(role: str, text: str) -> None:
        nonlocal any_
        hashed.update(f"{chr(10) * any_}{role}:{text}".encode())
        any_ = True

    def inserts() -> None:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state = int(_GIVEN[state])
            say(_ROLES[state], "")
            at += 1

    def done() -> pa.RecordBatch:
        inserts()
        return pa.RecordBatch.from_arrays([pa.array([here], ids), pa.array([hashed.hexdigest()])], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        ids = batch.schema.field(0).type
        for c, part, role, text in zip(*[batch.column(k).to_pylist() for k in (0, 1, 3, 4)]):
            if part is None:
                if here is not none:
                    yield done()
                here, audit, at, state, hashed, any_ = c, text, 0, NOTHING, hashlib.sha256(), False
                continue
            inserts()
            if audit[at] == "K":
                state = int(_KEPT[_INITIALS[role[0]], state])
                say(role, text)
            elif audit[at] == "R":
                state = int(_GIVEN[state])
                say(_ROLES[state], text)
            at += 1
    if here is not none:
        yield done()


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation of ``rows``: its faults, the cost and letters of its least cheapest edits, and the hash of what they leave."""
    spark = rows.sparkSession
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    read = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = read.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, START_CHARS)).sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = dict(read.dtypes)["conv_id"]
    found = stored(dealt.mapInArrow(_inner, f"conv_id {kind}, {RESULT}, part int, k long, turn long, role string, text string"), "conversations")
    names = [x.split()[0] for x in RESULT.split(", ")]
    inside = found.filter("audit is not null").select("conv_id", *names)

    #: the first and last conversation of each range
    edge = found.filter("audit is null").select("conv_id", "part", "k", "turn", "role", "text")
    #: one shuffle's worth of rows at most, the text only as what is asked of it
    end = F.rtrim("text", F.lit(SPACE_CHARS))
    thin = edge.select("conv_id", "part", "k", "turn", F.substring("role", 1, 1).alias("i"), (end == "").alias("blank"), ((end != "") & ~F.substring(end, -1, 1).isin(".", "!", "?")).alias("late"), F.concat(F.md5("role"), F.md5("text")).alias("print"))
    initial = F.when(F.col("i") == "s", 0).when(F.col("i") == "u", 1).when(F.col("i") == "a", 2).otherwise(_OTHER)
    repeats = thin.filter("not blank").groupBy("conv_id", "print").agg(F.min(F.struct("part", "k")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeats = stored(repeats.select(F.col("conv_id").alias("c"), F.col("print").alias("p"), "first"), "conversations-repeats")
    marked = thin.join(repeats, thin["conv_id"].eqNullSafe(repeats["c"]) & (thin["print"] == repeats["p"]), "left")
    marked = marked.select("part", "conv_id", "k", initial.alias("i"), "blank", "late", F.coalesce(~F.col("blank") & (F.struct("part", "k") != F.col("first")), F.lit(False)).alias("again"))
    fragments = marked.repartition(n, "part").sortWithinPartitions("part", "k").mapInArrow(_fragments, f"part int, conv_id {kind}, {_FRAGMENT}")
    fragments = fragments.select("conv_id", "part", "blank", "duplicate", "truncated", "illegal", "first", "last", "costs", "audits")
    whole = fragments.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_folded, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    whole = stored(whole, "conversations-edges")
    turns = edge.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    lead = whole.select("conv_id", F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    streamed = lead.unionByName(edge.select("conv_id", "part", "k", "role", "text")).repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("part").asc_nulls_first(), "k")
    hashes = streamed.mapInArrow(_hashed, f"conv_id {kind}, repaired_sha256 string")
    for other, c in ((turns, "c1"), (hashes, "c2")):
        other = other.withColumnRenamed("conv_id", c)
        whole = whole.join(other, whole["conv_id"].eqNullSafe(other[c])).drop(c)
    return inside.unionByName(whole.select("conv_id", *names))


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults, by a checksum of conversation and turn: dropped, emptied, cut, repeated, given to the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(id_col), F.lit(":"), said(turn_col))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col))
    read = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.when(kind == 4, "user").otherwise(said(role_col)).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
    return read.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("col")


def repair_damaged(rows: DataFrame, **columns: str) -> DataFrame:
    """Every conversation of ``rows`` after its damage and repair; one of which no row is left has zeros and the empty string's hash."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    repaired = repair_conversations(damaged(rows, **columns)).select(F.col("conv_id").alias("c"), *names)
    every = rows.select(F.col(columns.get("id_col", "conv_id")).alias("conv_id")).distinct()
    out = every.join(repaired, every["conv_id"].eqNullSafe(repaired["c"]), "left")
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(none.get(c, 0))).alias(c) for c in names])
