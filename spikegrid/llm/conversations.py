"""Repair of conversations: the cheapest edits after which roles alternate.

The rows of a conversation go by turn (null turns first; ties by role, then the SHA-256 of
the text, so equal rows are neighbours). The first fault that applies to a row counts: blank
(no character but space), duplicate (role and text seen earlier in the conversation),
truncated (the last character that is no space does not end a sentence). Edits are: keep a
row (0), give it the role user or assistant (3), delete it (4; the only choice for blank and
duplicate rows), insert an empty user or assistant row anywhere (3); a truncated row that
stays costs 3 more. The initials of the roles must then read ``(s?(ua)+)?``. Of the cheapest
ways the one whose edits, written K, R, D, I in order, come first in ASCII is taken.

**Survivor-coalescence Viterbi.** One survivor is kept for each state of the pattern, in a
tree of backpointers with reference counts. When a step leaves the root one child, all
survivors share that ancestor and its edit is emitted; branches without survivors go at
once, as do survivors that another one beats whatever follows, so memory holds the
unresolved part alone. Of two survivors of equal cost in one state
the whole unresolved suffixes are compared: a row's edits end with the edit of the row, so no
suffix is the beginning of another.

**Long conversations are cut.** Rows are ordered by range over the whole table, so a
conversation with a third of all rows lies in many pieces of about ``rows`` rows. For a
conversation of more than one piece each piece is summed up as the cost, and the rank of the
edits, from each state to each state; the same search over these sums tells each piece the
states it starts and ends in, and all pieces are then resolved side by side. Only ids, turns,
initials and faults take part; texts are joined to the edits at the end. The digest of one
conversation's repaired text is a hash of one stream by its definition: it is read in order
by one task, which holds one batch.

Null roles and texts are one space, so such a row is blank. A null conversation id is a
conversation of its own. A role of any other initial can be deleted or given another role.
Rows that repeat in full are duplicates of the first. Further columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Hashable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikegrid.llm.common import SPACES, saved

ROWS = 16384            # rows of one piece
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLE = {"u": "user", "a": "assistant"}
# states of the pattern: nothing yet, after s, after u, after a; the first and last may end it
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
FILL = ["u", "u", "a", "u"]                 # what an inserted or renamed row becomes
STATES = range(4)
LEGAL = ("su", "ua", "au")


def _after_inserts(state: int) -> list[tuple[int, int]]:
    """(state, inserts) within reach; more inserts only return to states reached before."""
    out, seen = [(state, 0)], {state}
    while (t := NEXT[out[-1][0]][FILL[out[-1][0]]]) not in seen:
        out.append((t, len(out)))
        seen.add(t)
    return out


def _lead(state: int, other: int) -> int:
    """What it costs at most to go on from ``state`` as any way from ``other`` would: inserts
    lead to a state that allows all that ``other`` allows (``u`` and, where it can, the end);
    what only the start allows, keeping an s row, is matched by deleting that row."""
    allows = {0: {0: 0, 3: DELETE}, 1: {0: 0, 1: 0, 3: 0}, 2: {2: 0}, 3: {0: 0, 3: 0}}[other]
    return min((n * INSERT + allows[t] for t, n in _after_inserts(state) if t in allows), default=1 << 30)


LEAD = [[_lead(s, t) for t in STATES] for s in STATES]
ENDS = [min((n * INSERT, "I" * n) for t, n in _after_inserts(s) if t in (0, 3)) for s in STATES]
FAULTS = ("", "blank", "duplicate", "truncated")


def _moves(initial: str, fault: str) -> list[list[tuple[int, str, int]]]:
    """For each state the (state after the row, edits, cost) worth taking."""
    out = []
    for s in STATES:
        best: dict[int, tuple[int, str]] = {}
        for t, n in _after_inserts(s):
            ways = [(t, "D", DELETE)]
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED * (fault == "truncated")
                ways.append((NEXT[t][FILL[t]], "R", REROLE + more))
                if initial in NEXT[t]:
                    ways.append((NEXT[t][initial], "K", KEEP + more))
            for end, edit, cost in ways:
                best[end] = min(best.get(end, (1 << 30, "")), (n * INSERT + cost, "I" * n + edit))
        out.append([(end, edits, cost) for end, (cost, edits) in sorted(best.items())])
    return out


MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in FAULTS}


class Node:
    """A step of a survivor: where it came from, what it did, how many lead on from it."""

    __slots__ = ("parent", "label", "state", "kids")

    def __init__(self, parent: Node | None, label: Hashable, state: int) -> None:
        self.parent, self.label, self.state, self.kids = parent, label, state, 0


class Survivors:
    """The cheapest way to each state, the least by labels where costs tie."""

    def __init__(self, state: int) -> None:
        self.root = Node(None, None, state)
        self.tips: dict[int, tuple[int, Node]] = {state: (0, self.root)}

    @staticmethod
    def _before(a: Node, label_a: Hashable, b: Node, label_b: Hashable) -> bool:
        """Compares two whole suffixes back to the last step that both share."""
        left, right = [label_a], [label_b]
        while a is not b:
            left.append(a.label)
            right.append(b.label)
            a, b = a.parent, b.parent
        return left[::-1] < right[::-1]

    def step(self, moves: list[list[tuple[int, Hashable, int]]]) -> None:
        new: dict[int, tuple[int, Node, Hashable]] = {}
        for s, (so_far, tip) in self.tips.items():
            for t, label, cost in moves[s]:
                held = new.get(t)
                if held is None or so_far + cost < held[0] or (so_far + cost == held[0] and self._before(tip, label, held[1], held[2])):
                    new[t] = so_far + cost, tip, label
        old, self.tips = self.tips, {}
        for t, (cost, parent, label) in new.items():
            if any(c + LEAD[s][t] < cost for s, (c, _, _) in new.items()):
                continue                        # no way on from here can be the cheapest
            parent.kids += 1
            self.tips[t] = cost, Node(parent, label, t)
        for _, tip in old.values():
            self._release(tip)

    def _release(self, node: Node) -> None:
        while not node.kids and node is not self.root:
            node = node.parent
            node.kids -= 1

    def _path(self, tip: Node) -> list[Node]:
        out = []
        while tip is not self.root:
            out.append(tip)
            tip = tip.parent
        return out[::-1]

    def shared(self) -> Iterator[tuple[int, Node]]:
        """(state before, step) of the steps that all survivors share, oldest first."""
        if self.root.kids == 1:
            for node in self._path(next(iter(self.tips.values()))[1]):
                if self.root.kids != 1:
                    break
                yield self.root.state, node
                self.root = node
                node.parent = None

    def end(self, state: int | None, ends: list[tuple[int, Hashable]]) -> tuple[int, Hashable, list[tuple[int, Node]]]:
        """Cost, last label, and the (state before, step) left, to a given state or to the best end."""
        best = None
        for s, (cost, tip) in self.tips.items():
            more, label = (0, "") if state is not None else ends[s]
            if state in (None, s) and (best is None or cost + more < best[0] or (
                    cost + more == best[0] and self._before(tip, label, best[2], best[1]))):
                best = cost + more, label, tip
        cost, label, tip = best
        steps = self._path(tip)
        before = [self.root.state, *(n.state for n in steps)]
        return cost, label, list(zip(before, steps))


def damaged(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that a checksum of id and turn deals out:
    dropped, emptied, without sentence ends, repeated, or with the role user."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    return table.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which the first may be null; the right side gives its other columns."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(keys[0]).eqNullSafe(F.col(f"_right_{keys[0]}"))] + [F.col(k) == F.col(f"_right_{k}") for k in keys[1:]]
    return left.join(named, on, how).drop(*(f"_right_{k}" for k in keys))


class Repair(NamedTuple):
    rows: DataFrame         # row, conv_id, turn, role, text as given
    edits: DataFrame        # row, conv_id, turn, place, piece, fault, illegal, edits, inserted, role, after, cost


def _ordered(rows: DataFrame, per_piece: int) -> DataFrame:
    """(conv_id, row, turn, initial, fault, place, piece): places follow the order of all rows."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    narrow = rows.select("conv_id", "row", "turn", "role", F.sha2("text", 256).alias("key"), (trimmed == "").alias("blank"),
                         (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("open"))
    again = narrow.groupBy("conv_id", "role", "key").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    again = again.where("n > 1").select("conv_id", "role", "key", F.col("first.row").alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("row") != F.col("first"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    known = _joined(narrow, again, ["conv_id", "role", "key"], "left").withColumn("fault", fault)
    order = ["conv_id", "turn", "role", "key", "row"]
    pieces = max(1, -(-rows.count() // per_piece))
    placed = known.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    placed = placed.select("conv_id", "row", "turn", F.substring("role", 1, 1).alias("initial"), "fault", F.monotonically_increasing_id().alias("place"))
    return saved(placed.withColumn("piece", F.shiftright("place", 33)), "ordered-turns")


def _class_of(initial: str, fault: str) -> list[list[tuple[int, str, int]]]:
    return MOVES[initial if initial in ("s", "u", "a") else "", fault]


def _summed(rows: pa.Table) -> tuple[list[int | None], list[int]]:
    """Least cost and rank of the edits from each state to each state over one piece."""
    rows = rows.sort_by("place")
    faults = list(zip(rows["initial"].to_pylist(), rows["fault"].to_pylist()))
    cost: list[int | None] = [None] * 16
    ways: list[tuple[str, ...]] = [()] * 16
    for s in STATES:
        run = Survivors(s)
        for initial, fault in faults:
            run.step(_class_of(initial, fault))
        for t, (c, tip) in run.tips.items():
            cost[4 * s + t], ways[4 * s + t] = c, tuple(n.label for n in run._path(tip))
    rank = {w: k for k, w in enumerate(sorted(set(ways)))}
    return cost, [rank[w] for w in ways]


def _routes(placed: DataFrame) -> DataFrame:
    """(conv_id, piece, entry, leave, before) for the pieces of conversations that lie in more
    than one; ``before`` is the initial of the row before the piece. A piece takes part in at
    most two of them, so these are at most twice as many rows as pieces."""
    kind = placed.schema["conv_id"].dataType.simpleString()
    ends = placed.groupBy("conv_id").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high").select("conv_id")
    long = _joined(placed.select("conv_id", "piece", "place", "initial", "fault"), ends, ["conv_id"], "left_semi")

    def sums(rows: pa.Table) -> pa.Table:
        cost, rank = _summed(rows)
        last = rows.sort_by("place")["initial"][-1]
        return pa.table({"conv_id": rows["conv_id"].slice(0, 1), "piece": rows["piece"].slice(0, 1), "cost": pa.array([cost], pa.list_(pa.int64())),
                         "rank": pa.array([rank], pa.list_(pa.int64())), "last": pa.array([last.as_py()], pa.string())})

    def routed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("piece")
        run = Survivors(0)
        for cost, rank in zip(rows["cost"].to_pylist(), rows["rank"].to_pylist()):
            run.step([[(t, rank[4 * s + t], cost[4 * s + t]) for t in STATES if cost[4 * s + t] is not None] for s in STATES])
        # labels are ranks here and the last one a text: no two ways share all ranks and differ only there
        _, _, steps = run.end(None, [(c, len(label)) for c, label in ENDS])
        leave = [n.state for _, n in steps[:-1]] + [None]
        return pa.table({"conv_id": rows["conv_id"], "piece": rows["piece"], "entry": pa.array([s for s, _ in steps], pa.int32()),
                         "leave": pa.array(leave, pa.int32()), "before": pa.array([None, *rows["last"].to_pylist()[:-1]], pa.string())})

    summed = long.groupBy("conv_id", "piece").applyInArrow(sums, f"conv_id {kind}, piece long, cost array<long>, rank array<long>, last string")
    return summed.groupBy("conv_id").applyInArrow(routed, f"conv_id {kind}, piece long, entry int, leave int, before string")


def _resolve(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Edits of the rows, which come in order, emitted as soon as all survivors agree."""
    out: list[tuple] = []
    run, at, waiting = None, None, deque()

    def fills(state: int, n: int) -> tuple[list[str], int]:
        roles = []
        for _ in range(n):
            roles.append(ROLE[FILL[state]])
            state = NEXT[state][FILL[state]]
        return roles, state

    def emitted(state: int, node: Node) -> None:
        row, initial, fault, illegal = waiting.popleft()
        inserted, state = fills(state, len(node.label) - 1)
        edit = node.label[-1]
        cost = INSERT * len(inserted) + (DELETE if edit == "D" else TRUNCATED * (fault == "truncated") + REROLE * (edit == "R"))
        out.append((*row, fault, illegal, node.label, inserted, ROLE[FILL[state]] if edit == "R" else None, [], cost))

    def finish(leave: int | None) -> None:
        _, label, steps = run.end(leave, ENDS)
        state = run.root.state
        for state, node in steps:
            emitted(state, node)
            state = node.state
        if label:
            after, _ = fills(state, len(label))
            *head, edits, inserted, role, _, cost = out[-1]
            out[-1] = (*head, edits + label, inserted, role, after, cost + INSERT * len(after))

    def flushed() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
        out.clear()
        return done

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for conv, row, turn, initial, fault, place, piece, entry, leave, before in zip(*columns):
            if at is None or (conv, piece) != at[0]:
                if run is not None:
                    finish(at[1])
                run, at, previous = Survivors(entry or 0), ((conv, piece), leave), before
            illegal = previous is not None and previous + initial not in LEGAL
            waiting.append(((row, conv, turn, place, piece), initial, fault, illegal))
            previous = initial
            run.step(_class_of(initial, fault))
            for state, node in run.shared():
                emitted(state, node)
        # the last row of a conversation can still get inserted rows: one row is held back
        if len(out) > 4096:
            held = out.pop()
            yield flushed()
            out.append(held)
    if run is not None:
        finish(at[1])
    if out:
        yield flushed()


def repair(table: DataFrame, rows: int = ROWS) -> Repair:
    """The cheapest edits of every conversation of (conv_id, turn, role, text)."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("text", "role"))
    given = saved(table.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", role, text), "turns")
    placed = _ordered(given, rows)
    routed = _joined(placed, _routes(placed), ["conv_id", "piece"], "left")
    kinds = {c: given.schema[c].dataType for c in ("conv_id", "turn")}
    routed = routed.select("conv_id", "row", "turn", "initial", "fault", "place", "piece", "entry", "leave", "before")
    routed = routed.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "place")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("row", pa.int64()), ("conv_id", first.schema.field("conv_id").type), ("turn", first.schema.field("turn").type),
                            ("place", pa.int64()), ("piece", pa.int64()), ("fault", pa.string()), ("illegal", pa.bool_()), ("edits", pa.string()),
                            ("inserted", pa.list_(pa.string())), ("new_role", pa.string()), ("after", pa.list_(pa.string())), ("cost", pa.int64())])

        def all_of() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        yield from _resolve(all_of(), schema)

    edits = routed.mapInArrow(search, f"row long, conv_id {kinds['conv_id'].simpleString()}, turn {kinds['turn'].simpleString()}, place long, piece long, "
                              "fault string, illegal boolean, edits string, inserted array<string>, new_role string, after array<string>, cost long")
    return Repair(given, saved(edits, "edits"))


def repaired(done: Repair) -> DataFrame:
    """(conv_id, place, no, role, text): the rows after repair, in order of place and no."""
    empty = lambda roles: F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.rtrim(F.col("edits"), F.lit("I")).endswith("D"), F.array()).otherwise(F.array(F.struct(F.coalesce("new_role", "role").alias("role"), "text")))
    lines = done.edits.join(done.rows.select("row", "role", "text"), "row")
    lines = lines.select("conv_id", "place", F.posexplode(F.concat(empty("inserted"), own, empty("after"))).alias("no", "line"))
    return lines.select("conv_id", "place", "no", "line.role", "line.text")


def _digest(done: Repair) -> DataFrame:
    """(conv_id, repaired_sha256) of the conversations that keep a row."""
    kind = done.rows.schema["conv_id"].dataType.simpleString()
    lines = repaired(done).select("conv_id", "place", "no", F.concat_ws(":", "role", "text").alias("line"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "no")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "repaired_sha256"]
        whole, own = None, None
        for batch in batches:
            ids, sums = [], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if whole is None or conv != own:
                    if whole is not None:
                        ids.append(own)
                        sums.append(whole.hexdigest())
                    whole, own = hashlib.sha256(), conv
                else:
                    whole.update(b"\n")
                whole.update(line.encode())
            of = batch.column(0).type
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, of), pa.array(sums)], names)
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], of), pa.array([whole.hexdigest()])], names)

    return lines.mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")


def audit(table: DataFrame, original: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """One row for each conversation of ``original`` (default: of the table): counts of faults,
    cost, edits in order, and the digest of the repaired text."""
    done = repair(table, rows)
    counted = lambda f: F.count_if(F.col("fault") == f).alias(f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    sums = done.edits.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), *map(counted, FAULTS[1:]), F.count_if("illegal").alias("illegal"), F.sum("cost").alias("cost"))

    def in_order(by: str, text: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, text))), lambda r: r[text]), "").alias(text)

    parts = done.edits.groupBy("conv_id", "piece").agg(in_order("place", "edits")).groupBy("conv_id").agg(in_order("piece", "edits"))
    out = (original if original is not None else table).select("conv_id").distinct()
    for part in (sums, parts, _digest(done)):
        out = _joined(out, part, ["conv_id"], "left")
    nothing = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *FAULTS[1:], "illegal", "cost")}
    return out.select("conv_id", *nothing.values(), F.coalesce("edits", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
