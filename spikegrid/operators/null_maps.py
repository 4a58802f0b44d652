"""Null maps of circularly shifted trains, with all iterations in one pass.

Neither spikes nor tracking are copied per iteration: a train travels once to each piece of
its session's tracking (a session that is not hot has one), where all shifts of all its
spikes find their nearest sample in the sorted times. What leaves the task are the counts
of the occupied bins. Maps of one session are scored as a stack of ``PART`` iterations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spikegrid.functions import map_scores
from spikegrid.functions.expr import Extent, grid_col, grid_row
from spikegrid.operators.maps import spread
from spikegrid.operators.ordered import Ordered, attach
from spikegrid.settings import DEFAULT, Settings

SESSION = ["session_id"]
UNIT = ["session_id", "unit"]
PART = 50               # iterations of one row of counts
CELLS = 1 << 20         # shifted spikes held at once


def _trains(spk: DataFrame, limit: float, settings: Settings) -> DataFrame:
    """(session_id, unit, ts, t0, t1, lim): trains packed in blocks of bounded size. The limit
    of the shift is lowered to the next whole number below half the span."""
    span = spk.groupBy(*UNIT).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("_n")).where("t1 > t0")
    half = (F.col("t1") - F.col("t0")) / 2
    low = F.floor(half).cast("double")
    lim = F.when(F.lit(float(limit)) >= half, F.when(low == half, low - 1).otherwise(low)).otherwise(F.lit(float(limit)))
    blocks = F.ceil(F.col("_n") / F.lit(settings.rows_per_chunk))
    rows = attach(spk, span.withColumns({"lim": lim, "blocks": blocks}), UNIT).withColumn("_block", F.pmod(F.xxhash64("i"), F.col("blocks")))
    return rows.groupBy(*UNIT, "_block").agg(F.collect_list("t").alias("ts"), *[F.first(c).alias(c) for c in ("t0", "t1", "lim", "blocks")]).drop("_block")


def _pieces(moving: DataFrame, ext: Extent, rows: int, cols: int, settings: Settings) -> tuple[DataFrame, bool]:
    """(session_id, times, bins, before, after, whole): sorted samples of each chunk of a session,
    with the last time before and the first after it, and whether it is all of the session."""
    binned = moving.select(*SESSION, "t", "i", (grid_row("y", ext, rows) * cols + grid_col("x", ext, cols)).alias("b"))
    o = Ordered(binned, SESSION, ["t", "i"], settings)
    packed = o._df.groupBy(*o.group).agg(F.sort_array(F.collect_list(F.struct("t", "i", "b"))).alias("_s"))
    packed = packed.select(*o.group, F.col("_s.t").alias("times"), F.col("_s.b").alias("bins"))
    if not o.chunked:
        return packed.withColumns({"before": F.lit(None).cast("double"), "after": F.lit(None).cast("double"), "whole": F.lit(True)}), False
    w = Window.partitionBy(*SESSION).orderBy(F.element_at("times", 1))
    ends = packed.select(*o.group, F.element_at("times", 1).alias("_first"), F.element_at("times", -1).alias("_last"))
    wide = Window.partitionBy(*SESSION).orderBy("_first")
    ends = ends.select(*o.group, F.lag("_last").over(wide).alias("before"), F.lead("_first").over(wide).alias("after"))
    return packed.join(ends, o.group).withColumn("whole", F.col("before").isNull() & F.col("after").isNull()).drop(*[c for c in o.group if c not in SESSION]), True


def _landed(ts, t0, t1, lim, times, before, after, shares: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(iterations, nearest sample of each spike in each of them) for some iterations at a time; a sample
    outside this piece is -1 or the number of its samples. Iteration 0 is the train itself, k the shift
    by ``shares[k - 1]``."""
    known = np.concatenate([[-np.inf if before is None else before], times, [np.inf if after is None else after]])
    move = np.concatenate([[0.0], lim + shares * (t1 - 2 * lim)])
    step = max(1, CELLS // max(1, len(ts)))
    for at in range(0, len(move), step):
        x = ts[:, None] + move[at:at + step]
        np.subtract(x, t1 - t0, out=x, where=x > t1)
        choose = np.searchsorted(times, x, side="right")
        choose -= x - known[choose] <= known[choose + 1] - x
        yield np.arange(at, min(at + step, len(move))), choose


def _first_of_instant(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of several samples at one instant the first counts."""
    keep = np.concatenate([[True], np.diff(times) > 0])
    return times[keep], bins[keep]


def _counted(ts, t0, t1, lim, times, bins, before, after, shares: np.ndarray, cells: int):
    """(iteration, bin, count) of the shifted spikes whose nearest sample lies in this piece."""
    times, bins = _first_of_instant(times, bins)
    found = []
    for k, choose in _landed(ts, t0, t1, lim, times, before, after, shares):
        mine = (choose >= 0) & (choose < len(times))
        key = (np.broadcast_to(k, choose.shape) * cells + bins[np.clip(choose, 0, len(times) - 1)])[mine]
        if len(k) * cells <= 32 * key.size:
            n = np.bincount(key - k[0] * cells, minlength=len(k) * cells)
            own = np.flatnonzero(n)
            key, n = own + k[0] * cells, n[own]
        else:
            key, n = np.unique(key, return_counts=True)
        found.append((key, n))
    key, n = (np.concatenate(c) for c in zip(*found))
    return key // cells, key % cells, n


def _counted_whole(ts, t0, t1, lim, times, bins, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, counts) of a session in one piece: the bins of its samples, and a row of counts for each iteration."""
    times, bins = _first_of_instant(times, bins)
    own, column = np.unique(bins, return_inverse=True)
    counts = np.empty((len(shares) + 1, len(own)))
    for k, choose in _landed(ts, t0, t1, lim, times, None, None, shares):
        key = column[choose] + (k - k[0]) * len(own)
        counts[k] = np.bincount(key.ravel(), minlength=len(k) * len(own)).reshape(len(k), -1)
    return own, counts


def _compared(values: np.ndarray, margin: float) -> np.ndarray:
    """For each column (observed, null_n, null_mean, null_std, below, above) of the first row against the others; a
    column without others has a null_n of 0."""
    first, null = values[0], np.ascontiguousarray(values[1:].T)
    known = ~np.isnan(null)
    n = known.sum(axis=1)
    slack = margin * np.maximum(1.0, np.abs(first))
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.sum(null, axis=1, where=known) / n
        std = np.sqrt(np.sum((null - mean[:, None]) ** 2, axis=1, where=known) / n)
        below = np.count_nonzero(null < (first - slack)[:, None], axis=1) / n       # never true of NaN
        above = np.count_nonzero(null > (first + slack)[:, None], axis=1) / n
    return np.vstack([first, n, mean, std, *(np.where(np.isnan(first), np.nan, x) for x in (below, above))])


def shifted_counts(spk: DataFrame, moving: DataFrame, ext: Extent, rows: int, cols: int, shares: Sequence[float], limit: float,
                   settings: Settings = DEFAULT) -> DataFrame:
    """(session_id, unit, part, iters, bins, counts): occupied bins of the maps of each train
    (iteration 0) and of its shifted copies, ``PART`` iterations in one row.

    ``spk``: session_id, unit, i, t.  ``moving``: session_id, i, t, x, y."""
    tracked, chunked = _pieces(moving, ext, rows, cols, settings)
    met = spread(attach(_trains(spk, limit, settings), tracked, SESSION), UNIT)
    return _pieces_counted(met, rows, cols, shares, chunked)


def _pieces_counted(met: DataFrame, rows: int, cols: int, shares: Sequence[float], chunked: bool) -> DataFrame:
    given, cells = np.asarray(shares, float), rows * cols
    kinds = {c: met.schema[c].dataType.simpleString() for c in UNIT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            col = {c: batch.column(names.index(c)) for c in names}
            for k in range(batch.num_rows):
                numbers = [np.asarray(col[c][k].values.to_numpy(zero_copy_only=False)) for c in ("ts", "times", "bins")]
                t0, t1, lim, before, after = (col[c][k].as_py() for c in ("t0", "t1", "lim", "before", "after"))
                it, b, n = _counted(numbers[0], t0, t1, lim, numbers[1], numbers[2], before, after, given, cells)
                cut = np.flatnonzero(np.diff(it // PART)) + 1
                starts = np.concatenate([[0], cut, [len(it)]]).astype(np.int32)
                if not len(it):
                    continue
                lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(v.astype(np.int32))) for v in (it, b, n)]
                own = [pa.array([col[c][k].as_py()] * (len(starts) - 1), batch.schema.field(c).type) for c in UNIT]
                yield pa.RecordBatch.from_arrays([*own, pa.array((it[starts[:-1]] // PART).astype(np.int32)), *lists], [*UNIT, "part", "iters", "bins", "counts"])

    out = met.mapInArrow(run, f"session_id {kinds['session_id']}, unit {kinds['unit']}, part int, iters array<int>, bins array<int>, counts array<int>")
    if chunked:      # pieces of one session, and blocks of one train, add up
        both = lambda c: F.flatten(F.collect_list(c)).alias(c)
        out = out.groupBy(*UNIT, "part").agg(both("iters"), both("bins"), both("counts"))
    return out


def _occupied(occ: DataFrame, cols: int) -> DataFrame:
    """(session_id, _b, _v): occupied bins of each session in one row."""
    seen = occ.groupBy(*SESSION).agg(F.collect_list(F.struct((F.col("r") * cols + F.col("c")).alias("b"), "v")).alias("_o"))
    return seen.select(*SESSION, F.col("_o.b").alias("_b"), F.col("_o.v").alias("_v"))


def shifted_report(spk: DataFrame, moving: DataFrame, occ: DataFrame, ext: Extent, rows: int, cols: int, shares: Sequence[float], limit: float,
                   names: Sequence[str] = map_scores.NAMES, settings: Settings = DEFAULT, margin: float = 1e-9) -> DataFrame:
    """The report of :func:`null_report` on the scores of all shifts of each train.

    The trains of a session that is not hot are counted, scored and compared in one task each,
    so that neither maps nor scores are shuffled; those of hot sessions go through
    :func:`shifted_counts`' pieces, :func:`map_null_scores` and :func:`null_report`."""
    names = list(names)
    tracked, chunked = _pieces(moving, ext, rows, cols, settings)
    met = attach(_trains(spk, limit, settings), tracked, SESSION)
    whole = F.col("whole") & (F.col("blocks") == 1)
    cut = chunked or settings.chunks is None          # without a plan a train may be hot where its session's samples are few
    if cut:
        counts = _pieces_counted(spread(met.where(~whole), UNIT), rows, cols, shares, True)
        hot = null_report(map_null_scores(counts, occ, rows, cols, names, settings), names, margin)
    met = spread(attach(met.where(whole), _occupied(occ, cols), SESSION), UNIT)
    given, cells = np.asarray(shares, float), rows * cols
    floor, p = settings.occupancy_floor, settings.active_percentile
    kinds = {c: met.schema[c].dataType.simpleString() for c in UNIT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index
            col = {c: batch.column(at(c)) for c in batch.schema.names}
            own, score, found = [], [], []
            for k in range(batch.num_rows):
                ts, times, bins, seen, v = (np.asarray(col[c][k].values.to_numpy(zero_copy_only=False)) for c in ("ts", "times", "bins", "_b", "_v"))
                t0, t1, lim = (col[c][k].as_py() for c in ("t0", "t1", "lim"))
                occupancy = np.zeros(cells)
                occupancy[seen] = v
                used, counts = _counted_whole(ts, t0, t1, lim, times, bins, given)
                numbers = _compared(map_scores.of_bins(counts, used, occupancy, rows, cols, floor, p, names=names), margin)
                some = np.flatnonzero(numbers[1])
                own += [k] * len(some)
                score += [names[j] for j in some]
                found.append(numbers[:, some])
            if score:
                numbers = np.concatenate(found, axis=1)
                columns = [pa.array(c, mask=np.isnan(c)) for c in numbers]
                columns[1] = pa.array(numbers[1].astype(np.int64))
                yield pa.RecordBatch.from_arrays([*[col[c].take(pa.array(own)) for c in UNIT], pa.array(score), *columns],
                                                 [*UNIT, "score", "observed", "null_n", "null_mean", "null_std", "below", "above"])

    out = met.mapInArrow(run, f"session_id {kinds['session_id']}, unit {kinds['unit']}, score string, observed double, null_n long, null_mean double, null_std double, below double, above double")
    return out.unionByName(hot) if cut else out


def map_null_scores(counts: DataFrame, occ: DataFrame, rows: int, cols: int, names: Sequence[str] = map_scores.NAMES,
                    settings: Settings = DEFAULT) -> DataFrame:
    """(session_id, unit, iter, scores...) of the maps of :func:`shifted_counts`; ``names`` may add 'grid'."""
    names = list(names)
    seen = _occupied(occ, cols)
    floor, p = settings.occupancy_floor, settings.active_percentile

    met = spread(attach(counts, seen, SESSION), [*UNIT, "part"]).select(*UNIT, "iters", "bins", "counts", "_b", "_v")
    kinds = {c: met.schema[c].dataType.simpleString() for c in UNIT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found, iterations = [], [], []
            for k in range(batch.num_rows):
                i, b, c, at, v = (np.asarray(batch.column(j)[k].values.to_numpy(zero_copy_only=False)) for j in range(2, 7))
                own, row = np.unique(i, return_inverse=True)
                maps, occupancy = np.zeros((len(own), rows * cols)), np.zeros(rows * cols)
                np.add.at(maps, (row, b), c)
                occupancy[at] = v
                found.append(map_scores.scores(maps, occupancy, rows, cols, floor, p, names=names))
                iterations.append(own)
                of.append(np.full(len(own), k))
            if found:
                values, of = np.concatenate(found), pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays([*[batch.column(j).take(of) for j in range(2)], pa.array(np.concatenate(iterations).astype(np.int32)),
                                                  *[pa.array(x, mask=np.isnan(x)) for x in values.T]], [*UNIT, "iter", *names])

    return met.mapInArrow(run, f"session_id {kinds['session_id']}, unit {kinds['unit']}, iter int, {', '.join(f'{n} double' for n in names)}")


def null_report(scored: DataFrame, names: Sequence[str] = map_scores.NAMES, margin: float = 1e-9) -> DataFrame:
    """(session_id, unit, score, observed, null_n, null_mean, null_std, below, above): each score
    of a train against its shifted copies; ``below`` and ``above`` are the shares of null values
    that differ from the observed one by more than a relative margin."""
    long = scored.select(*UNIT, "iter", F.explode(F.array(*[F.struct(F.lit(n).alias("score"), F.col(n).alias("v")) for n in names])).alias("x"))
    long = long.select(*UNIT, "iter", "x.score", "x.v")
    seen = long.where("iter = 0").select(*UNIT, "score", F.col("v").alias("observed"))
    slack = F.lit(margin) * F.greatest(F.lit(1.0), F.abs("observed"))
    null = attach(long.where("iter > 0 AND v IS NOT NULL"), seen, [*UNIT, "score"])
    share = lambda c: F.avg(c.cast("double"))
    return null.groupBy(*UNIT, "score").agg(
        F.first("observed").alias("observed"), F.count(F.lit(1)).alias("null_n"), F.avg("v").alias("null_mean"), F.stddev_pop("v").alias("null_std"),
        share(F.col("v") < F.col("observed") - slack).alias("below"), share(F.col("v") > F.col("observed") + slack).alias("above"))
