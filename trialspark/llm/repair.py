"""Conversation structure repair: the cheapest edits that give each conversation a legal order of roles.

Legal are the role initials `(s?(ua)+)?`. Rows are kept (K, 0), given the role user or assistant (R, 2) or
deleted (D, 3; the only choice for blank and duplicate rows), rows without text are inserted (I, 2), and a
truncated row that stays adds 1. Of equally cheap audits (the letters of the edits in order) the ASCII-least
is taken.

Method: a cost DP over nodes (row, state of the role automaton), then prefix-doubling path ranking: nodes
are ranked by the letters of their least optimal arcs over audits of 1, 2, 4, ... letters, each time from
the ranks of a node and of the node that its pointer, doubled as well, leads to. The ranks select the arc of
each node, and the doubled pointers yield all places of a path at once.

A conversation may be longer than a task should hold. Rows are ordered over all conversations and cut into
chunks; the part of a conversation inside a chunk is a segment. A segment acts on costs as a (min, +) matrix
over the states at its ends and, once the costs behind it are known, on states as a map. Both are carried
along the segments of a conversation in groups of bounded size, so only chunks meet in a task. What needs
all rows of a conversation (its digest) streams over them in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from trialspark.llm.common import held, in_chunks

CHUNK_ROWS = 4096
#: Segments of a conversation that are carried together.
FAN = 4096

# States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after the one role that an inserted or changed row can have, and that role.
NEXT = np.array([USER, USER, ASSISTANT, USER])
GIVEN = ["user", "user", "assistant", "user"]
#: State after a kept row by its initial (s, u, a, any other); -1 is not legal.
KEEP = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
NEVER = 1 << 40
#: Costs at the end of a conversation: inserts until the state is START or ASSISTANT.
END_COSTS = np.array([0, 4, 2, 0])
LETTERS = b"\0DIKR"  # in order; 0: no edit
DELETE, INSERT, KEPT, GIVE = 1, 2, 3, 4
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
SPACE = " \t\n\x0b\x0c\r"


class Rows:
    """Rows of whole chunks in order, cut into segments of one conversation each."""

    def __init__(self, initial: np.ndarray, gone: np.ndarray, cut: np.ndarray, first: np.ndarray):
        """initial: 0 to 3 for s, u, a, other; gone: must be deleted; cut: truncated; first: place of each segment's first row."""
        self.initial, self.gone, self.cut, self.first = initial, gone, cut.astype(np.int64), first
        self.stop = np.append(first[1:], len(initial))
        self.n = len(initial)

    def costs(self, end: np.ndarray) -> np.ndarray:
        """Cost to go of each (row, state[, target]) from the costs at the end of each segment (segment, state[, target])."""
        out = np.empty((self.n, *end.shape[1:]), np.int64)
        order = np.argsort(self.first - self.stop, kind="stable")  # longest first
        now, stop, length = end[order].copy(), self.stop[order], (self.stop - self.first)[order]
        active = len(order)
        for step in range(1, int(length.max(initial=0)) + 1):
            while active and length[active - 1] < step:
                active -= 1
            rows = stop[:active] - step
            now[:active] = out[rows] = self._row(now[:active], rows)
        return out

    def _row(self, after: np.ndarray, rows: np.ndarray) -> np.ndarray:
        wide = (slice(None),) + (None,) * (after.ndim - 1)
        stay = np.where(self.gone[rows], NEVER, self.cut[rows])[wide]
        to = KEEP[:, self.initial[rows]].T  # (row, state)
        kept = np.take_along_axis(after, np.maximum(to, 0).reshape(to.shape + (1,) * (after.ndim - 2)), 1)
        kept = kept + np.where(to < 0, NEVER, 0).reshape(to.shape + (1,) * (after.ndim - 2)) + stay
        now = np.minimum(np.minimum(after + 3, kept), after[:, NEXT] + 2 + stay)
        for _ in range(2):  # two inserts at most are of use in one place
            now = np.minimum(now, now[:, NEXT] + 2)
        return np.minimum(now, NEVER)

    def ranked(self, end: np.ndarray, last: np.ndarray) -> "Paths":
        """Least optimal paths, given the costs at the end of each segment; last: segments that end their conversation."""
        cost = np.concatenate([self.costs(end), end]).reshape(-1)
        n, segments = self.n, len(self.first)
        state = np.tile(np.arange(4), n + segments)
        row = np.repeat(np.arange(n + segments), 4)
        behind = np.arange(1, n + 1)  # row after each row; segment s ends in row n + s
        behind[self.stop - 1] = n + np.arange(segments)
        inner = row < n
        after = np.where(inner, behind[np.minimum(row, n - 1)] * 4, row * 4)
        edge = np.minimum(row, n - 1)
        stay = np.where(self.gone[edge], NEVER, self.cut[edge])
        to = KEEP[state, self.initial[edge]]
        arcs = [  # target, cost, possible; in order of the letters
            (after + state, 3, inner), (row * 4 + NEXT[state], 2, inner | np.repeat(np.append(np.zeros(n, bool), last), 4)),
            (after + np.maximum(to, 0), stay, inner & (to >= 0)), (after + NEXT[state], stay + 2, inner)]
        here = np.arange(len(state))
        optimal = [ok & (cost == cost[target] + w) & (cost < NEVER) for target, w, ok in arcs]
        # audits of one letter, then of twice as many each time
        rank = np.select(optimal, [DELETE, INSERT, KEPT, GIVE], 0)
        jump = np.select(optimal, [target for target, _, _ in arcs], here)
        jumps, dist = [jump], [(jump != here).astype(np.int64)]
        while (jumps[-1][jumps[-1]] != jumps[-1]).any():
            jump = jumps[-1]
            pair = rank.astype(np.int64) * (int(rank.max()) + 1) + rank[jump]
            rank = np.unique(pair, return_inverse=True)[1]
            dist.append(dist[-1] + dist[-1][jump])
            jumps.append(jump[jump])
        # the arc of each node: least letter, then least rank of what follows
        best = np.full(len(here), np.iinfo(np.int64).max)
        letter, chosen = np.zeros(len(here), np.int64), here.copy()
        for code, (ok, (target, _, _)) in enumerate(zip(optimal, arcs), 1):
            key = code * (int(rank.max()) + 1) + rank[target]
            better = ok & (key < best)
            best, letter, chosen = np.where(better, key, best), np.where(better, code, letter), np.where(better, target, chosen)
        if not (chosen == jumps[0]).all():
            raise AssertionError("a letter leads to one node only")
        return Paths(self, letter, jumps, dist[-1])


class Paths:
    def __init__(self, rows: Rows, letter: np.ndarray, jumps: list[np.ndarray], length: np.ndarray):
        self.rows, self.letter, self.jumps, self.length = rows, letter, jumps, length

    def exits(self) -> np.ndarray:
        """State at the end of each segment (segment, state at its start)."""
        return self.jumps[-1][self.rows.first[:, None] * 4 + np.arange(4)] % 4

    def edits(self, entry: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Letters of each row (inserts before it, its own, inserts after the last) and the state before the row."""
        start = self.rows.first * 4 + entry
        length = self.length[start]
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        node = np.repeat(start, length)
        for bit, jump in enumerate(self.jumps):
            node = np.where(place >> bit & 1, jump[node], node)
        segment = np.repeat(np.arange(len(start)), length)
        row = np.minimum(node // 4, self.rows.stop[segment] - 1)  # inserts at the end belong to the last row
        text = np.frombuffer(LETTERS, np.uint8)[self.letter[node]].tobytes().decode()
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        return [text[a:b] for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(text)])], node[begin] % 4


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows spoilt by a rule: dropped, emptied, without `.!?`, repeated, or with the role user.

    The rule is crc32 of `conv_id:turn` modulo 20 (0 to 4); nulls of any column read as one space in the key and in
    role and text, conv_id and turn themselves stay null.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rule = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), rule.alias("rule"))
    text = F.when(F.col("rule") == 1, "").when(F.col("rule") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.filter("rule <> 0").select("conv_id", "turn", F.when(F.col("rule") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                                           F.explode(F.when(F.col("rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with `conv` (a key without nulls), `pos` (their order), `key` (role and text) and what their text shows."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    table = rows.select(conv.alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    table = table.withColumns({"key": key, "blank": trimmed == "", "cut": ~F.substring(trimmed, -1, 1).isin(".", "!", "?")})
    by = ["conv", "turn", "role", "key"]
    table = table.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = "conv string, turn long, role string, key string, blank boolean, cut boolean, text string, pos long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield batch.append_column("pos", pa.array(np.arange(at, at + batch.num_rows)))
            at += batch.num_rows

    names = [x.split()[0] for x in schema.split(", ")]
    return table.select(*names[:-1], "conv_id").mapInArrow(number, schema.replace("text string,", f"text string, conv_id {table.schema['conv_id'].dataType.simpleString()},"))


def _faulty(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """(chunk, pos, conv, initial, fault): narrow rows with their first fault (1 blank, 2 duplicate, 3 truncated)."""
    initial = F.coalesce(F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.substring("role", 1, 1)), F.lit(0))
    initial = F.when(initial == 0, 3).otherwise(initial - 1).cast("int")
    narrow = rows.select("conv", "pos", "key", "blank", "cut", initial.alias("initial"))
    again = narrow.groupBy("conv", "key").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1").select("conv", "key", "first")
    narrow = narrow.join(again, ["conv", "key"], "left")
    fault = F.when(F.col("blank"), 1).when(F.col("pos") > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0)
    return narrow.select(F.floor(F.col("pos") / chunk_rows).cast("long").alias("chunk"), "pos", "conv", "initial", fault.cast("int").alias("fault"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole chunks; rows come in order of the chunks, a few thousand rows at a time."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 2 * CHUNK_ROWS):
            part = batch.slice(at, 2 * CHUNK_ROWS)
            chunk = part.column("chunk").to_numpy()
            last = int(np.searchsorted(chunk, chunk[-1]))  # rows before the last chunk
            if last:
                yield pa.Table.from_batches([*rest, part.slice(0, last)]).combine_chunks()
                rest = []
            elif rest and rest[-1].column("chunk")[-1].as_py() != int(chunk[-1]):
                yield pa.Table.from_batches(rest).combine_chunks()
                rest = []
            rest.append(part.slice(last))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _segments(table: pa.Table) -> tuple[Rows, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Rows, and of each segment its chunk, whether it is the first or last of it, and its conversation."""
    chunk = table.column("chunk").to_numpy()
    conv = table.column("conv").combine_chunks()
    codes = conv.dictionary_encode().indices.to_numpy()
    new = np.ones(len(chunk), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (chunk[1:] != chunk[:-1])
    first = np.flatnonzero(new)
    fault = table.column("fault").to_numpy()
    rows = Rows(table.column("initial").to_numpy(), (fault == 1) | (fault == 2), fault == 3, first)
    own = chunk[first]
    opens, closes = np.ones(len(own), bool), np.ones(len(own), bool)
    opens[1:] = closes[:-1] = own[1:] != own[:-1]
    return rows, own, opens, closes, conv.take(pa.array(first)).to_pylist()


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), NEVER)


def _carry(segments: DataFrame, backward: bool, fan: int) -> DataFrame:
    """(conv, no, value): what enters each segment from the segments before it (behind it, if backward).

    `m` of a segment is a (min, +) matrix of costs (backward; values are the costs of the four states) or a map of
    states (forward; the value is one state). Groups hold at most `fan` segments; of more, totals go one level up.
    """
    schema = "conv string, no long, value array<long>"

    def enter(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("no").to_pylist(), table.column("m").to_pylist(), table.column("value").to_pylist()), reverse=backward)
        value, out = np.array(rows[0][2]), []
        for _, m, _ in rows:
            out.append(value.tolist())
            value = np.minimum((np.array(m).reshape(4, 4) + value).min(axis=1), NEVER) if backward else np.array(m)[value]
        return pa.table({"conv": table.column("conv"), "no": pa.array([no for no, _, _ in rows], pa.int64()), "value": pa.array(out, pa.list_(pa.int64()))})

    def total(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("no").to_pylist(), table.column("m").to_pylist()))
        m = np.array(rows[0][1])
        for _, x in rows[1:]:
            m = _product(m.reshape(4, 4), np.array(x).reshape(4, 4)).reshape(-1) if backward else np.array(x)[m]
        return pa.table({"conv": table.column("conv").slice(0, 1), "no": table.column("group").slice(0, 1), "m": pa.array([m.tolist()], pa.list_(pa.int64()))})

    outer = F.array(*[F.lit(int(x)).cast("long") for x in (END_COSTS if backward else [START])])
    most = segments.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    if most <= fan:
        return segments.withColumn("value", outer).groupBy("conv").applyInArrow(enter, schema)
    segments = segments.withColumn("group", F.floor(F.col("no") / fan).cast("long"))
    above = held(segments.groupBy("conv", "group").applyInArrow(total, "conv string, no long, m array<long>"), "totals")
    carried = _carry(above, backward, fan).withColumnRenamed("no", "group")
    return segments.join(carried, ["conv", "group"]).groupBy("conv", "group").applyInArrow(enter, schema)


def _edges(narrow: DataFrame, fan: int) -> DataFrame:
    """(chunk, end, entry, last): costs behind the last segment of each chunk, state before its first, and whether its last
    segment ends the conversation. Only conversations of more than one segment are carried."""
    longs = pa.list_(pa.int64())
    fields = [("conv", pa.string()), ("no", pa.int64()), ("m", longs), ("opens", pa.bool_()), ("closes", pa.bool_())]
    schema, names = pa.schema(fields), "conv string, no long, m array<long>, opens boolean, closes boolean"
    unit = np.where(np.eye(4, dtype=bool), 0, NEVER)

    def out(own, opens, closes, conv, m) -> pa.RecordBatch:
        edge = np.flatnonzero(opens | closes)
        return pa.RecordBatch.from_arrays([pa.array([conv[i] for i in edge], pa.string()), pa.array(own[edge]), pa.array(m[edge].reshape(len(edge), -1).tolist(), longs),
                                           pa.array(opens[edge]), pa.array(closes[edge])], schema=schema)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            rows, own, opens, closes, conv = _segments(table)
            cost = rows.costs(np.broadcast_to(unit, (len(own), 4, 4)))
            yield out(own, opens, closes, conv, cost[rows.first])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            rows, own, opens, closes, conv = _segments(table)
            end, last = _ends(table, rows, closes)
            yield out(own, opens, closes, conv, rows.ranked(end, last).exits())

    many = lambda t: t.join(t.groupBy("conv").count().filter("count > 1").select("conv"), "conv")
    found = held(many(narrow.mapInArrow(matrices, names)), "matrices")
    end = held(_carry(found.select("conv", "no", "m"), True, fan), "end-costs")
    # the last segment of a conversation takes the costs of the end, which no other has: it ends the conversation
    stops = found.groupBy("conv").agg(F.max("no").alias("no"), F.lit(True).alias("stop"))
    closing = found.filter("closes").join(end, ["conv", "no"]).join(stops, ["conv", "no"], "left").select(F.col("no").alias("chunk"), F.col("value").alias("end"), F.coalesce("stop", F.lit(False)).alias("last"))
    closing = held(closing, "closing")
    chunks = found.select(F.col("no").alias("chunk")).distinct()
    near = _with_edges(narrow.join(chunks, "chunk", "left_semi"), closing)
    states = held(_carry(near.mapInArrow(maps, names).join(stops.select("conv"), "conv", "left_semi").select("conv", "no", "m"), False, fan), "entry-states")
    entry = found.filter("opens").join(states, ["conv", "no"]).select(F.col("no").alias("chunk"), F.col("value")[0].alias("entry"))
    return held(closing.join(entry, "chunk", "full_outer"), "edges")


def _with_edges(narrow: DataFrame, edges: DataFrame) -> DataFrame:
    return narrow.join(edges, "chunk", "left").repartition("chunk").sortWithinPartitions("chunk", "pos")


def _ends(table: pa.Table, rows: Rows, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs at the end of each segment, and whether its conversation ends there."""
    end, last = np.tile(END_COSTS, (len(rows.first), 1)), np.ones(len(rows.first), bool)
    known, stop = table.column("end"), table.column("last")
    for segment in np.flatnonzero(closes).tolist():
        value = known[int(rows.first[segment])].as_py()
        if value is not None:
            end[segment], last[segment] = value, stop[int(rows.first[segment])].as_py()
    return end, last


def _edits(narrow: DataFrame) -> DataFrame:
    """(conv, pos, edits, state, fault) of each row."""
    schema = pa.schema([("conv", pa.string()), ("pos", pa.int64()), ("edits", pa.string()), ("state", pa.int32()), ("fault", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            rows, _, opens, closes, _ = _segments(table)
            entry = np.zeros(len(rows.first), np.int64)
            known = table.column("entry")
            for segment in np.flatnonzero(opens).tolist():
                entry[segment] = known[int(rows.first[segment])].as_py() or START
            letters, state = rows.ranked(*_ends(table, rows, closes)).edits(entry)
            cols = [table.column("conv"), table.column("pos"), pa.array(letters), pa.array(state, pa.int32()), table.column("fault")]
            yield from pa.Table.from_arrays(cols, schema=schema).to_batches()

    return narrow.mapInArrow(run, "conv string, pos long, edits string, state int, fault int")


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, fan: int = FAN) -> DataFrame:
    """(conv_id, conv, pos, turn, fault, was, edit, role, text): one row for each edit, in order.

    A conversation's rows are taken by turn, nulls first; rows of one turn by role and digest of the text. fault is
    the row's first: 1 blank, 2 duplicate (role and text of an earlier row), 3 truncated, 0 none; `was` is its role before.
    Inserted rows have no turn, fault and `was`; deleted rows have no role and text. Nulls in role and text read as one space,
    rows with a null conv_id are one conversation, repeated rows are duplicates, an empty table gives an empty table, and
    other columns are ignored. Each partition of the result holds whole conversations, sorted by (conv, pos).
    """
    rows = held(_ordered(rows), "turns")
    narrow = held(_faulty(rows, chunk_rows), "faults")
    edges = _edges(narrow.repartition("chunk").sortWithinPartitions("chunk", "pos"), fan)
    edits = _edits(_with_edges(narrow, edges))
    kind = rows.schema["conv_id"].dataType.simpleString()
    wide = rows.select("conv", "pos", F.lit(1).alias("side"), "conv_id", "turn", "role", "text", *[F.lit(None).cast(t).alias(c) for c, t in (("edits", "string"), ("state", "int"), ("fault", "int"))])
    edits = edits.select("conv", "pos", F.lit(0).alias("side"), *[F.lit(None).cast(t).alias(c) for c, t in (("conv_id", kind), ("turn", "long"), ("role", "string"), ("text", "string"))], "edits", "state", "fault")
    both = wide.unionByName(edits).repartition("conv").sortWithinPartitions("conv", "pos", "side")
    fields = f"conv_id {kind}, conv string, pos long, turn long, fault int, was string, edit string, role string, text string"

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        letters = state = fault = None
        for batch in batches:
            for i in range(batch.num_rows):
                conv, pos, side, conv_id, turn, role, text, e, s, f = (c[i].as_py() for c in batch.columns)
                if not side:  # the edits of a row come just before the row
                    letters, state, fault = e, s, f
                    continue
                for letter in letters:
                    if letter == "I":
                        yield conv_id, conv, pos, None, None, None, "I", GIVEN[state], ""
                        state = int(NEXT[state])
                    elif letter == "D":
                        yield conv_id, conv, pos, turn, fault, role, "D", None, None
                    elif letter == "R":
                        yield conv_id, conv, pos, turn, fault, role, "R", GIVEN[state], text
                        state = int(NEXT[state])
                    else:
                        yield conv_id, conv, pos, turn, fault, role, "K", role, text
                        state = int(KEEP[state, "sua".index(role[0])])

    types = both.sparkSession.createDataFrame([], fields).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from in_chunks(merged(batches), to_arrow_schema(types), 1000)

    return both.mapInArrow(run, fields)


class Report:
    """What is counted while the edits of one conversation stream by."""

    def __init__(self, conv_id):
        self.conv_id, self.faults, self.illegal, self.cost, self.turns = conv_id, [0, 0, 0, 0], 0, 0, 0
        self.low = self.high = self.initial = None
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0

    def add(self, turn, fault, was, edit, role, text) -> None:
        if was is not None:
            self.faults[fault] += 1
            if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = was[:1]
            if turn is not None:  # in order
                self.turns += turn != self.high
                self.low, self.high = turn if self.low is None else self.low, turn
        self.audit.append(edit)
        self.cost += COST[edit] + (fault == 3 and edit != "D")
        if edit != "D":
            self.digest.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def reports(edits: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of repair()."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    types = edits.sparkSession.createDataFrame([], fields).schema

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        report = current = None
        for batch in batches:
            for i in range(batch.num_rows):
                conv_id, conv, turn, *rest = (c[i].as_py() for c in batch.columns)
                if report is None or conv != current:
                    if report:
                        yield report.row()
                    report, current = Report(conv_id), conv
                report.add(turn, *rest)
        if report:
            yield report.row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from in_chunks(stream(batches), to_arrow_schema(types), 1000)

    return edits.select("conv_id", "conv", "turn", "fault", "was", "edit", "role", "text").mapInArrow(run, fields)


def repair_report(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS, fan: int = FAN) -> DataFrame:
    """Reports of all conversations after damaged(); one of which no row is left has zeros, an empty audit and the digest of nothing."""
    found = held(reports(repair(damaged(conversations), chunk_rows, fan)), "reports")
    every = conversations.select(F.col("conv_id").alias("__id")).distinct()
    rows = every.join(found, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return rows.select(F.col("__id").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(none.get(c, 0))).cast(found.schema[c].dataType).alias(c) for c in found.columns[1:]])
