"""Neighbour-based divergence of point samples with several features.

The nearest neighbours are exact and no group is compared in one piece. In
:func:`nearest_other` the searched points of a key are dealt to cells around pivots, a cell
above ``rows`` points to blocks. A point first searches its home cell; the distance found
there bounds the search, so it visits only those other cells whose ball (pivot, radius) can
hold something nearer. A kernel sees a batch of points and one block.

:func:`neighbour_divergence` searches the units that make up the pairs, not the pairs: the
points of a session lie in blocks of ``BLOCK_ROWS`` (many small units, or a part of a large
one), two blocks with units that are compared meet once, and a point is copied once for each
block that its own meets, however many pairs its unit is in. Within a meeting the search goes
through the same cells and balls.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spikegrid.functions.expr import digest_number
from spikegrid.operators.ordered import Ordered, attach, broadcast_if_small
from spikegrid.session import computed_once
from spikegrid.settings import DEFAULT, Settings

PIVOTS = 64             # at most, for one key
CELL_ROWS = 4096        # points of one block, and of one batch that visits it
BLOCK_ROWS = 1 << 15    # points of a session that meet others together
SLICE = 4096            # points of a unit whose distances to all partners are gathered in one task


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def mixture_rank(points: DataFrame, keys: Sequence[str], row_key: Sequence[str], seed: int = 0, settings: Settings = DEFAULT,
                 name: str = "draw") -> DataFrame:
    """Numbers the rows of each key in the order of a digest of their key: the first k rows
    are a sample without replacement, the same at any partitioning."""
    drawn = points.withColumn("_u", digest_number(*row_key, seed=seed))
    return Ordered(drawn, keys, ["_u", *row_key], settings).number(name).df.drop("_u")


def mixtures(points: DataFrame, pairs: DataFrame, site: Sequence[str], seed: int = 0, settings: Settings = DEFAULT) -> DataFrame:
    """(site, prev_no, session_no, unit_a, unit_b, side, spike_idx, features, in_mixture, draw, first).

    Both samples of every pair of units of two sessions; the mixture takes all rows of the
    smaller side and as many drawn rows of the larger. ``draw`` numbers the rows of a unit, and
    each row is marked ``first`` in one of the pairs that it is in."""
    unit = [*site, "session_no", "label"]
    ranked = mixture_rank(points, unit, ["spike_idx"], seed, settings)
    sizes = points.groupBy(*unit).agg(F.count(F.lit(1)).alias("n"))
    side = lambda no, u, n: sizes.select(*site, F.col("session_no").alias(no), F.col("label").alias(u), F.col("n").alias(n))
    both = pairs.join(side("prev_no", "unit_a", "n_a"), [*site, "prev_no"]).join(side("session_no", "unit_b", "n_b"), [*site, "session_no"])
    both = both.withColumn("_take", F.least("n_a", "n_b"))
    ends = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("prev_no").alias("no"), F.col("unit_a").alias("unit")),
                             F.struct(F.lit("b").alias("side"), F.col("session_no").alias("no"), F.col("unit_b").alias("unit"))))
    wanted = both.select(*site, "prev_no", "session_no", "unit_a", "unit_b", "_take", ends.alias("e")).select(
        *site, "prev_no", "session_no", "unit_a", "unit_b", "_take", F.col("e.side").alias("side"), F.col("e.no").alias("_no"), F.col("e.unit").alias("_unit"))
    ends_of_unit = Window.partitionBy(*site, "_no", "_unit").orderBy("prev_no", "session_no", "unit_a", "unit_b", "side")
    wanted = wanted.withColumn("first", F.row_number().over(ends_of_unit) == 1)
    rows = ranked.withColumnsRenamed({"session_no": "_no", "label": "_unit"}).join(wanted, [*site, "_no", "_unit"])
    return rows.select(*site, "prev_no", "session_no", "unit_a", "unit_b", "side", "spike_idx", "features", (F.col("draw") <= F.col("_take")).alias("in_mixture"), "draw", "first")


# ------------------------------------------------------------ nearest neighbours
def _pivots(searched: DataFrame, keys: Sequence[str], rows: int, most: int) -> DataFrame:
    """(keys, pivots): a few points of each key, more where it holds more, drawn by digest."""
    n = searched.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    drawn = searched.withColumn("_u", F.xxhash64("v"))
    first = drawn.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("_u", "id"))).where(F.col("_rn") <= most)
    first = attach(first, n, keys).where(F.col("_rn") <= F.ceil(F.col("_n") / F.lit(rows)))
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_rn").alias("cell"), "v"))).alias("_pivots"))


def _home(v: Column, pivots: Column) -> Column:
    """(squared distance, cell) of the nearest pivot."""
    return F.array_min(F.transform(pivots, lambda p: F.struct(squared_distance(v, p["v"]).alias("d"), p["cell"].alias("cell"))))


def _least_positive(left: pa.Table, right: pa.Table) -> pa.Table:
    """The least positive squared distance from each point to a block; null if there is none."""
    schema = pa.schema([("id", pa.int64()), ("d", pa.float64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    x, y = (np.stack(t["v"].to_numpy(zero_copy_only=False)) for t in (left, right))
    out = least_positive(x, y)
    return pa.table([left["id"], pa.array(out, from_pandas=False, mask=np.isinf(out))], schema=schema)


def least_positive(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least positive squared distance from each row of ``x`` to the rows of ``y``; infinite if there is none.

    A matrix product gives all distances but for rounding; those that may be zero or least are
    computed anew from the differences, so the result is theirs."""
    with np.errstate(over="ignore", invalid="ignore"):
        x2, y2 = (x * x).sum(axis=1), (y * y).sum(axis=1)
    if not np.isfinite(x2).all() or not np.isfinite(y2).all() or x2.max() > 1e300 or y2.max() > 1e300:
        return _least_plain(x, y)
    if _may_repeat(y):
        y = np.unique(y, axis=0)                    # copies would all be computed anew
    y2 = (y * y).sum(axis=1)
    slack = 4 * (x.shape[1] + 4) * np.finfo(float).eps * (x2 + y2.max())
    right = np.vstack([-2 * y.T, np.ones(len(y)), y2])
    out = np.full(len(x), np.inf)
    step = max(1, (1 << 21) // len(y))
    for at in range(0, len(x), step):
        part, room = x[at:at + step], slack[at:at + step, None]
        d = np.hstack([part, x2[at:at + step, None], np.ones((len(part), 1))]) @ right
        least = d.min(axis=1, keepdims=True)
        rows, columns = np.nonzero(d <= room) if (least <= room).any() else (np.empty(0, int),) * 2
        if len(rows):
            d[rows, columns] = np.inf
            least = d.min(axis=1, keepdims=True)
        more = np.nonzero(d <= least + 3 * room)
        rows, columns = np.concatenate([rows, more[0]]), np.concatenate([columns, more[1]])
        for k in range(0, len(rows), 1 << 14):
            r, c = rows[k:k + (1 << 14)], columns[k:k + (1 << 14)]
            exact = ((part[r] - y[c]) ** 2).sum(axis=1)
            exact[exact == 0] = np.inf
            np.minimum.at(out, at + r, exact)
    return out


def _may_repeat(y: np.ndarray) -> bool:
    """Whether two rows have one hash of their bits."""
    weight = np.random.default_rng(0).integers(1 << 62, size=y.shape[1], dtype=np.uint64) * 2 + 1
    bits = np.ascontiguousarray(y, float).view(np.uint64)
    return len(np.unique(((bits ^ (bits >> np.uint64(29))) * weight).sum(axis=1, dtype=np.uint64))) < len(y)


def _least_plain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same from all differences, for values whose squares are not finite."""
    out = np.empty(len(x))
    step = max(1, (1 << 20) // max(1, y.size))
    for at in range(0, len(x), step):
        d = ((x[at:at + step, None, :] - y[None, :, :]) ** 2).sum(axis=2)
        d[d == 0] = np.inf
        out[at:at + step] = d.min(axis=1)
    return out


def _visited(points: DataFrame, stored: DataFrame, blocks: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """(id, d) over all blocks of the cells that ``points`` (keys, id, v, cell) name."""
    split = attach(points, blocks, [*keys, "cell"])
    split = split.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    here = points.groupBy(*keys, "cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("turns"))
    split = attach(split, here, [*keys, "cell"]).withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns")).cast("int"))
    there = attach(stored, here, [*keys, "cell"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    group = [*keys, "cell", "block", "turn"]
    fresh = lambda df, *names: df.select(*[F.col(c).alias(c) for c in (*group, *names)]).groupBy(*group)
    met = fresh(split, "id", "v").cogroup(fresh(there, "v"))      # both sides may come from one table
    return met.applyInArrow(_least_positive, "id long, d double")


def nearest_other(points: DataFrame, searched: DataFrame, keys: Sequence[str], rows: int = CELL_ROWS, most: int = PIVOTS) -> DataFrame:
    """Each point with the distance to the nearest of the searched rows of its key that is
    not at the same place (null if there is none).

    ``points``, ``searched``: keys, id, v; ids of points are unique over all keys."""
    keys = list(keys)
    pivots = computed_once(_pivots(searched, keys, rows, most))
    placed = attach(searched, pivots, keys).withColumn("_h", _home(F.col("v"), F.col("_pivots")))
    stored = placed.select(*keys, "id", "v", F.col("_h.cell").alias("cell"), F.sqrt("_h.d").alias("_r"))
    cells = stored.groupBy(*keys, "cell").agg(F.max("_r").alias("radius"), F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("blocks"))
    cells = computed_once(cells)
    stored = attach(stored.drop("_r"), cells.drop("radius"), [*keys, "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    asked = attach(points.select(*keys, "id", "v"), pivots, keys)
    home = asked.select(*keys, "id", "v", _home(F.col("v"), F.col("_pivots"))["cell"].alias("cell"))
    first = _visited(home, stored, cells.drop("radius"), keys, rows).groupBy("id").agg(F.min("d").alias("d"))
    first = computed_once(first)
    # a cell can hold something nearer only if its ball comes closer than what is found
    balls = pivots.select(*keys, F.explode("_pivots").alias("p")).select(*keys, F.col("p.cell").alias("cell"), F.col("p.v").alias("pv"))
    balls = balls.join(cells, [*keys, "cell"]).groupBy(*keys).agg(F.collect_list(F.struct("cell", "pv", "radius")).alias("_balls"))
    more = attach(home.withColumnRenamed("cell", "_own").join(first, "id", "left"), balls, keys)
    reach = F.filter("_balls", lambda b: (b["cell"] != F.col("_own")) & (
        F.col("d").isNull() | (F.sqrt(squared_distance(F.col("v"), b["pv"])) - b["radius"] <= F.sqrt("d") * F.lit(1 + 1e-9))))
    more = more.select(*keys, "id", "v", F.explode(F.transform(reach, lambda b: b["cell"])).alias("cell"))
    all_found = first.unionByName(_visited(more, stored, cells.drop("radius"), keys, rows)).groupBy("id").agg(F.min("d").alias("_d"))
    return points.join(all_found, "id", "left").withColumn("distance", F.sqrt("_d")).drop("_d")


# ------------------------------------------------------------------ divergence
def _units(sizes: DataFrame, site: Sequence[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """(site, no, unit, n, at), the place of each unit's first point among those of its session, and
    (site, no, unit, block, no_y, unit_y, block_y, take), the blocks of units that meet: those of side a
    with those of side b, and those of a unit with its own. ``take`` is the points in the mixture,
    or all of the unit."""
    own = lambda k: [F.col(c).alias(to) for c, to in zip({"a": ("prev_no", "unit_a"), "b": ("session_no", "unit_b")}[k], ("no", "unit"))]
    of = sizes.where("side = 'a'").select(*site, *own("a"), "n", "_in").unionByName(sizes.where("side = 'b'").select(*site, *own("b"), "n", "_in"))
    before = Window.partitionBy(*site, "no").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    units = computed_once(of.select(*site, "no", "unit", "n").distinct().withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))))
    block = lambda place: F.floor(place / rows).cast("int")
    reach = lambda df, to, start, end: df.withColumn(to, F.explode(F.sequence(block(F.col(start)), block(F.col(start) + F.col(end) - 1))))
    alone = of.select(*site, "no", "unit", F.explode(F.array("n", "_in")).alias("take")).distinct()
    alone = attach(alone, units, [*site, "no", "unit"])
    alone = reach(reach(alone, "block", "at", "n"), "block_y", "at", "n").where("block <= block_y")
    alone = alone.select(*site, "no", "unit", "block", F.col("no").alias("no_y"), F.col("unit").alias("unit_y"), "block_y", "take")
    there = units.select(*site, *[F.col(c).alias(f"{c}_y") for c in ("no", "unit", "n", "at")])
    crossed = sizes.where("side = 'a'").select(*site, *own("a"), F.col("session_no").alias("no_y"), F.col("unit_b").alias("unit_y"), F.col("_in").alias("take"))
    crossed = crossed.join(units, [*site, "no", "unit"]).join(there, [*site, "no_y", "unit_y"])
    crossed = reach(reach(crossed, "block", "at", "n"), "block_y", "at_y", "n_y").select(alone.columns)
    return units, alone.withColumn("alone", F.lit(True)).unionByName(crossed.withColumn("alone", F.lit(False)))


def least_in_cells(x: np.ndarray, y: np.ndarray, rows: int = 512, most: int = PIVOTS) -> np.ndarray:
    """:func:`least_positive` through cells of ``y`` around pivots: a point first searches its home cell,
    then those whose ball can hold something nearer."""
    count = min(most, len(y) // rows)
    if count < 2 or not np.isfinite(x).all() or not np.isfinite(y).all():
        return least_positive(x, y)
    pivots = y[np.linspace(0, len(y) - 1, count).astype(int)]
    apart = lambda v: np.sqrt(np.stack([((v - p) ** 2).sum(axis=1) for p in pivots], axis=1))
    far, of_y = apart(x), apart(y)
    home = of_y.argmin(axis=1)
    cells = [y[home == k] for k in range(count)]
    radius = np.array([of_y[home == k, k].max(initial=0) for k in range(count)])
    if (np.sort(far, axis=1)[:, 1] - radius.max() <= 0).mean() > 0.9:     # the balls lie in each other: nothing can be left out
        return least_positive(x, y)
    out, own = np.full(len(x), np.inf), far.argmin(axis=1)
    for k in range(count):
        if len(cells[k]) and (mine := own == k).any():
            out[mine] = least_positive(x[mine], cells[k])
    for k in range(count):
        more = (own != k) & (far[:, k] * (1 - 1e-12) - radius[k] <= np.sqrt(out) * (1 + 1e-9))
        if len(cells[k]) and more.any():
            out[more] = np.minimum(out[more], least_positive(x[more], cells[k]))
    return out


def _least_of_first(x: np.ndarray, y: np.ndarray, takes: Sequence[int]) -> list[np.ndarray]:
    """For each of the growing numbers ``takes`` the least positive squared distances to so many first rows of ``y``."""
    out, found = [], np.full(len(x), np.inf)
    for start, end in pairwise([0, *takes]):
        if end > start:
            found = np.fmin(found, least_in_cells(x, y[start:end]))
        out.append(found)
    return out


def _met(left: pa.Table, right: pa.Table, schema: pa.Schema) -> pa.Table:
    """The least distances of the units of two blocks that are compared, or of one block, both ways.
    Rows of ``left`` without a ``draw`` say which."""
    def units(t: pa.Table) -> dict:
        t = t.filter(pc.is_valid(t["draw"])).sort_by("draw").combine_chunks()
        if not t.num_rows:
            return {}
        number = t["unit"].chunk(0).dictionary_encode()
        code, draw = number.indices.to_numpy(zero_copy_only=False), t["draw"].to_numpy()
        v = np.stack(t["v"].to_numpy(zero_copy_only=False))
        return {u: (draw[code == k], v[code == k]) for k, u in enumerate(number.dictionary.to_pylist())}

    said = left.filter(pc.is_null(left["draw"]))
    x, y = units(left), units(right)
    tile = {n: said[n][0].as_py() for n in schema.names if n in said.column_names and n != "unit"}
    meetings: dict = {}
    for u, w, take, alone in zip(*(said[c].to_pylist() for c in ("unit", "unit_y", "take", "alone"))):
        meetings.setdefault((u, w, alone), set()).add(take)
    made: list[dict] = []

    def put(no, u, no_y, w, side, take, draw, d) -> None:
        piece = (draw - 1) // SLICE
        for k in np.unique(piece):
            mine = piece == k
            made.append(tile | {"no": no, "unit": u, "slice": int(k), "no_y": no_y, "unit_y": w, "side": side, "take": take, "draws": draw[mine].astype(np.int32), "d": d[mine]})

    here, there = said["no"][0].as_py(), said["no_y"][0].as_py()
    for (u, w, alone), takes in meetings.items():
        same = alone and not y                     # a block with itself
        (draw, v), (draw_y, v_y) = x[u], x[u] if same else y[w]
        takes = sorted(takes)
        ways = [(here, u, there, w, "a", draw, v, draw_y, v_y)] + ([] if same else [(there, w, here, u, "b", draw_y, v_y, draw, v)])
        for no, unit, no_y, unit_y, side, mine, v_mine, others, v_others in ways:
            first = np.searchsorted(others, takes, side="right")
            for take, d in zip(takes, _least_of_first(v_mine, v_others, first)):
                put(no, unit, no_y, unit_y, None if alone else side, take, mine, d)
    return pa.Table.from_pylist(made, schema=schema)


def _summed(t: pa.Table, schema: pa.Schema) -> pa.Table:
    """(site, no, unit, no_y, unit_y, side, sum, open) of a slice of a unit and each of its partners."""
    least: dict = {}
    for no_y, unit_y, side, take, draws, d in zip(*(t[c].to_pylist() if c not in ("draws", "d") else t[c] for c in ("no_y", "unit_y", "side", "take", "draws", "d"))):
        at = least.setdefault((no_y, unit_y, side, take) if side else take, np.full(SLICE, np.inf))
        place = (draws.values.to_numpy() - 1) % SLICE
        at[place] = np.fmin(at[place], d.values.to_numpy())
    alone = {k: np.sqrt(v) for k, v in least.items() if not isinstance(k, tuple)}
    own = alone[max(alone)]                            # of all points of the unit
    points = np.zeros(SLICE, bool)
    for draws in t["draws"]:
        points[(draws.values.to_numpy() - 1) % SLICE] = True
    fixed = {c: t[c][0].as_py() for c in schema.names if c in t.column_names and c not in ("no_y", "unit_y", "side")}
    made = []
    for (no_y, unit_y, side, take), d in ((k, v) for k, v in least.items() if isinstance(k, tuple)):
        s = np.fmin(np.sqrt(d), alone[take])
        some = points & np.isfinite(s) & np.isfinite(own) | np.isnan(s + own) & points
        made.append(fixed | {"no_y": no_y, "unit_y": unit_y, "side": side, "_sum": float(np.log2(s[some] / own[some]).sum()), "_open": int(points.sum() - some.sum())})
    return pa.Table.from_pylist(made, schema=schema)


def _sent(samples: DataFrame, sizes: DataFrame, pair: Sequence[str], rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """The points of both blocks of each meeting, with the columns that name it: each point once for each block that its
    own meets. Rows of the first table without a ``draw`` say which units are compared."""
    site = list(pair[:-4])
    units, meetings = _units(sizes, site, rows)
    met = computed_once(meetings).withColumn("no_x", F.col("no"))
    tile = [*site, "no_x", "block", "no_y", "block_y"]
    ends = lambda a, b: F.when(F.col("side") == "a", F.col(a)).otherwise(F.col(b))
    points = samples.where("first").select(*site, ends("prev_no", "session_no").alias("no"), ends("unit_a", "unit_b").alias("unit"),
                                           F.col("draw").cast("long").alias("draw"), F.col("features").alias("v"))
    points = attach(points, broadcast_if_small(units.drop("n")), [*site, "no", "unit"])
    points = points.withColumn("_own", F.floor((F.col("at") + F.col("draw") - 1) / rows).cast("int")).drop("at")
    at_x = met.select(*tile, "no", "unit", F.col("block").alias("_own")).distinct()
    at_y = met.where("NOT alone OR block < block_y").select(*tile, F.col("no_y").alias("no"), F.col("unit_y").alias("unit"), F.col("block_y").alias("_own")).distinct()
    sent = lambda where: points.join(broadcast_if_small(where), [*site, "no", "unit", "_own"]).select(*tile, "no", "unit", "draw", "v")
    left, right = sent(at_x), sent(at_y)
    none = lambda c: F.lit(None).cast(left.schema[c].dataType).alias(c)
    said = met.select(*tile, "no", "unit", none("draw"), none("v"), "unit_y", "take", "alone")
    left = left.withColumns({c: F.lit(None).cast(said.schema[c].dataType) for c in ("unit_y", "take", "alone")})
    return left.unionByName(said), right, tile


def _least_sums(samples: DataFrame, sizes: DataFrame, pair: Sequence[str], rows: int) -> DataFrame:
    """(pair, side, _sum, _open): the sum of log2(s / r) over the points of each side, and how many lack one of them."""
    left, right, tile = _sent(samples, sizes, pair, rows)
    site, n = tile[:-4], 4 * int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))      # few and long tasks: not to be coalesced by size
    dealt = lambda df: df.repartition(n, *tile).select(*[F.col(c).alias(c) for c in df.columns]).groupBy(*tile)
    kind = lambda c: left.schema[c].dataType.simpleString()
    partner = [*[f"{c} {kind(c)}" for c in (*site, "no", "unit", "no_y", "unit_y")], "side string"]
    fields = ", ".join([*partner, "slice int, take long, draws array<int>, d array<double>"])
    found_as, summed_as = _arrow_schema(fields), _arrow_schema(", ".join([*partner, "_sum double, _open long"]))
    found = dealt(left).cogroup(dealt(right)).applyInArrow(lambda a, b: _met(a, b, found_as), fields)
    sums = found.groupBy(*site, "no", "unit", "slice").applyInArrow(lambda t: _summed(t, summed_as), ", ".join([*partner, "_sum double, _open long"]))
    ends = lambda a, b: F.when(F.col("side") == "a", F.col(a)).otherwise(F.col(b))
    named = sums.select(*site, ends("no", "no_y").alias("prev_no"), ends("no_y", "no").alias("session_no"), ends("unit", "unit_y").alias("unit_a"),
                        ends("unit_y", "unit").alias("unit_b"), "side", "_sum", "_open")
    return named.groupBy(*pair, "side").agg(F.sum("_sum").alias("_sum"), F.sum("_open").alias("_open"))


def _arrow_schema(fields: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(fields))


def neighbour_divergence(samples: DataFrame, pair: Sequence[str], d: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """(pair, kl_a, kl_b, jsd): divergence of each side of a pair from their mixture, in bits,
    and the root of half their sum.

    ``samples`` as from :func:`mixtures`, ``pair`` the columns of the site and prev_no, session_no,
    unit_a, unit_b. For n points of a side and m of the mixture the
    divergence is d / n * sum(log2(s / r)) + log2(m / (n - 1)), with r and s the distances to
    the nearest other point of the side and of the mixture; below 0 it counts as 0. A side
    whose points all coincide, or of one point, has no divergence.

    A unit has the same points, and the same r, in each of its pairs; the first of them as
    numbered by ``draw`` are in the mixture. So s is the least distance to the first points of
    the unit itself and of its partner."""
    pair = list(pair)
    sizes = computed_once(samples.groupBy(*pair, "side").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_mixture").alias("_in")))
    sums = attach(sizes, _least_sums(samples, sizes, pair, rows), [*pair, "side"])
    wide = sums.groupBy(*pair).agg(*[F.max(F.when(F.col("side") == k, F.col(c))).alias(f"{c}_{k}") for k in "ab" for c in ("n", "_in", "_sum", "_open")])

    def kl(k: str) -> Column:
        n, m = F.col(f"n_{k}"), F.col("_in_a") + F.col("_in_b")
        value = F.lit(float(d)) / n * F.col(f"_sum_{k}") + F.log2(m / (n - 1))
        return F.when((n > 1) & (F.col(f"_open_{k}") == 0), F.greatest(value, F.lit(0.0)))

    out = wide.withColumns({"kl_a": kl("a"), "kl_b": kl("b")})
    return out.select(*pair, "kl_a", "kl_b", F.sqrt((F.col("kl_a") + F.col("kl_b")) / 2).alias("jsd"))
