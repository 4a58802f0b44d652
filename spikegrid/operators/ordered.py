"""Ordered operators whose groups may be arbitrarily large.

A plain ``Window.partitionBy(session).orderBy(t)`` puts a whole session into one
task.  ``Ordered`` knows the rows per key (a ``ChunkPlan`` of the base table, or one
column-pruned count).  If every group is small the plain window is used.  Otherwise the hot keys are cut
into order-preserving chunks of bounded size, all windows run per (key, chunk),
and only a few rows per chunk travel between neighbouring chunks:

* ``near``    lag/lead and bounded frames: edge rows are copied to the neighbours;
* ``running`` cumulative sums: chunk totals are accumulated and added;
* ``fill``    carry the last / next known value: one value per chunk is carried.

The cut points are fixed before the main plan runs, so a recomputed task puts a
row into the same chunk as the lost one did.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spikegrid.session import checkpoint_dir
from spikegrid.settings import DEFAULT, Settings

CHUNK = "_chunk"
_HALO = "_halo"
_MAX_CUTS = 4096


def axis_value(df: DataFrame, column: str) -> Column:
    """The ordering column as a double (timestamps become microseconds)."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(column).cast("double")
    return F.col(column).cast("double")


def _with_key_match(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Null-safe join that keeps the columns of ``df`` once."""
    t = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(t, cond, how).drop(*[f"_k_{k}" for k in keys])


@dataclass(frozen=True)
class ChunkPlan:
    """Which keys of a table are hot, and where their ordering axis is cut.

    A plan made from a base table also serves every table derived from it without
    adding rows per key: put it into ``Settings.chunks`` and the operators neither
    count again nor run their input for that.  ``cuts`` is None if no key is hot.
    """

    keys: tuple[str, ...]
    axis: str
    cuts: DataFrame | None

    def renamed(self, **names: str) -> "ChunkPlan":
        cuts = self.cuts.withColumnsRenamed(names) if self.cuts is not None else None
        return ChunkPlan(tuple(names.get(k, k) for k in self.keys), self.axis, cuts)


def plan_chunks(df: DataFrame, keys: Sequence[str], axis: str, settings: Settings = DEFAULT) -> ChunkPlan:
    """Find the keys with more than ``rows_per_chunk`` rows and cut them.

    A hot key is cut at approximate quantiles of the ordering column, so chunks
    hold about equally many rows whatever its distribution; rows with equal
    values stay together.  The cut points are materialised once (they come from
    a sketch, which a recomputation could give differently).
    """
    spark, limit, cap = df.sparkSession, settings.rows_per_chunk, settings.broadcast_keys
    slim = df.select(*keys, axis_value(df, axis).alias("_a"))
    hot = slim.groupBy(*keys).agg(F.count("_a").alias("_n")).where(F.col("_n") > limit)
    found = hot.orderBy(F.desc("_n")).limit(cap + 1).collect()
    if not found:
        return ChunkPlan(tuple(keys), axis, None)
    few = len(found) <= cap
    if few:
        hot = F.broadcast(spark.createDataFrame(found, hot.schema))
    grid = min(_MAX_CUTS, -(-found[0]["_n"] // limit))
    shares = [k / grid for k in range(1, grid)] or [0.5]
    stride = F.greatest(F.lit(1), F.floor(F.lit(grid) / F.ceil(F.col("_n") / F.lit(limit)))).cast("int")
    cuts = (
        _with_key_match(slim, hot, keys, "inner")
        .groupBy(*keys)
        .agg(F.percentile_approx("_a", shares, max(10_000, 4 * grid)).alias("_all"), F.max("_n").alias("_n"))
        .select(*keys, F.array_distinct(F.filter("_all", lambda v, i: i % stride == 0)).alias("_cuts"))
    )
    # at most one cut per rows_per_chunk rows: small enough to send to every task
    if few:
        cuts = F.broadcast(spark.createDataFrame(cuts.collect(), cuts.schema))
    else:
        checkpoint_dir(spark)
        cuts = cuts.checkpoint()
    return ChunkPlan(tuple(keys), axis, cuts)


def place_in_chunks(df: DataFrame, plan: ChunkPlan, axis: str) -> DataFrame:
    """``df`` with its ``_chunk`` number (-1 for keys that are not hot)."""
    a = axis_value(df, axis)
    # binary search in the cuts of the key: how many lie below the value
    steps = F.array(*[F.lit(1 << b) for b in range(_MAX_CUTS.bit_length() - 1, -1, -1)])
    below = F.aggregate(
        steps, F.lit(0),
        lambda pos, step: F.when(F.get(F.col("_cuts"), pos + step - 1) < a, pos + step).otherwise(pos),
    )
    return _with_key_match(df, plan.cuts, plan.keys, "left").withColumn(
        CHUNK, F.when(F.col("_cuts").isNull() | a.isNull(), F.lit(-1)).otherwise(below)
    ).drop("_cuts")


class Ordered:
    """A table with an order inside each key, safe against hot keys."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], settings: Settings = DEFAULT):
        self.keys = list(keys)
        self.order = list(order)
        self.settings = settings
        axis, plan = self.order[0], settings.chunks
        if plan is None or not set(plan.keys) <= set(self.keys):
            plan = plan_chunks(df, self.keys, axis, settings)
        elif plan.cuts is not None and axis.lstrip("_") != plan.axis:
            plan = plan_chunks(df, self.keys, axis, settings)   # hot keys, but another order
        self.chunked = plan.cuts is not None
        self._df = place_in_chunks(df, plan, axis) if self.chunked else df

    def _with(self, df: DataFrame) -> "Ordered":
        other = object.__new__(Ordered)
        other.__dict__.update(self.__dict__)
        other._df = df
        return other

    # ------------------------------------------------------------------ access
    @property
    def df(self) -> DataFrame:
        return self._df.drop(CHUNK) if self.chunked else self._df

    @property
    def group(self) -> list[str]:
        return self.keys + ([CHUNK] if self.chunked else [])

    @property
    def window(self) -> WindowSpec:
        """Window over one chunk (over the whole key if nothing was cut)."""
        return Window.partitionBy(*self.group).orderBy(*self.order)

    @property
    def backwards(self) -> WindowSpec:
        """The window from its end.  What lies ahead of a row is read here as what came before it:
        a frame that starts at the row is computed anew for each row, one that ends there is not."""
        return Window.partitionBy(*self.group).orderBy(*[F.col(c).desc() for c in self.order])

    def then_by(self, *columns: str) -> "Ordered":
        """The same table with rows of equal order told apart by more columns."""
        other = self._with(self._df)
        other.order = [*self.order, *columns]
        return other

    def columns(self, exprs: Mapping[str, Column]) -> "Ordered":
        return self._with(self._df.withColumns(dict(exprs)))

    def where(self, cond: Column) -> "Ordered":
        return self._with(self._df.where(cond))

    def _chunk_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(CHUNK)

    # ------------------------------------------------------------------- near
    def near(self, before: int, after: int, build: Callable[[WindowSpec], Mapping[str, Column]]) -> "Ordered":
        """Window expressions that look at most ``before`` rows back, ``after`` ahead."""
        if not self.chunked:
            return self._with(self._df.withColumns(dict(build(self.window))))
        flagged = self._df.withColumn(_HALO, F.lit(False))
        parts = flagged
        names = self._df.select(*self.group).distinct()
        for reach, order, frame in (
            (before, [F.col(c).desc() for c in self.order], (1, before)),
            (after, [F.col(c).asc() for c in self.order], (-after, -1)),
        ):
            if reach == 0:
                continue
            rank = F.row_number().over(Window.partitionBy(*self.group).orderBy(*order))
            edge = self._df.withColumn("_rn", rank).where(F.col("_rn") <= reach).drop("_rn")
            near = F.collect_list(CHUNK).over(self._chunk_window().rowsBetween(*frame))
            halo = (
                _with_key_match(edge, names.withColumn("_to", near), self.group, "inner")
                .withColumn(CHUNK, F.explode("_to"))
                .withColumn(_HALO, F.lit(True))
                .select(*flagged.columns)
            )
            parts = parts.unionByName(halo)
        return self._with(parts.withColumns(dict(build(self.window))).where(~F.col(_HALO)).drop(_HALO))

    def lag_lead(self, spec: Mapping[str, tuple[str | Column, int]]) -> "Ordered":
        """``name -> (column, offset)``; negative offsets look back."""
        before = max([0] + [-o for _, o in spec.values()])
        after = max([0] + [o for _, o in spec.values()])
        return self.near(
            before,
            after,
            lambda w: {
                n: (F.lag(c, -o).over(w) if o < 0 else F.lead(c, o).over(w)) for n, (c, o) in spec.items()
            },
        )

    # ---------------------------------------------------------------- carries
    def _attach(self, per_chunk: DataFrame) -> DataFrame:
        return _with_key_match(self._df, per_chunk, self.group, "inner")

    def running(self, sums: Mapping[str, Column], inclusive: bool = True) -> "Ordered":
        """Cumulative sums from the start of the key up to (and with) the row."""
        end = 0 if inclusive else -1
        frame = self.window.rowsBetween(Window.unboundedPreceding, end)
        zero = F.lit(0)
        if not self.chunked:
            return self._with(
                self._df.withColumns({n: F.coalesce(F.sum(e).over(frame), zero) for n, e in sums.items()})
            )
        w = self._chunk_window().rowsBetween(Window.unboundedPreceding, -1)
        totals = self._df.groupBy(*self.group).agg(*[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()])
        offsets = totals.select(*self.group, *[F.sum(f"_s_{n}").over(w).alias(f"_o_{n}") for n in sums])
        joined = self._attach(offsets)
        out = joined.withColumns(
            {
                n: F.coalesce(F.col(f"_o_{n}"), zero) + F.coalesce(F.sum(e).over(frame), zero)
                for n, e in sums.items()
            }
        )
        return self._with(out.drop(*[f"_o_{n}" for n in sums]))

    def number(self, name: str) -> "Ordered":
        """Row number from 1 inside each key."""
        return self.running({name: F.lit(1).cast("long")})

    def fill(self, last: Mapping[str, Column] | None = None, first: Mapping[str, Column] | None = None) -> "Ordered":
        """Last non-null value up to the row, first non-null value from the row on."""
        last, first = dict(last or {}), dict(first or {})
        back = self.window.rowsBetween(Window.unboundedPreceding, 0)
        ahead = self.backwards.rowsBetween(Window.unboundedPreceding, 0)
        local = {n: F.last(e, ignorenulls=True).over(back) for n, e in last.items()}
        local |= {n: F.last(e, ignorenulls=True).over(ahead) for n, e in first.items()}
        if not self.chunked:
            return self._with(self._df.withColumns(local))
        key = F.struct(*self.order)
        aggs = [F.max_by(e, F.when(e.isNotNull(), key)).alias(f"_s_{n}") for n, e in last.items()]
        aggs += [F.min_by(e, F.when(e.isNotNull(), key)).alias(f"_s_{n}") for n, e in first.items()]
        ends = self._df.groupBy(*self.group).agg(*aggs)
        wb = self._chunk_window().rowsBetween(Window.unboundedPreceding, -1)
        wa = self._chunk_window().rowsBetween(1, Window.unboundedFollowing)
        carried = ends.select(
            *self.group,
            *[F.last(f"_s_{n}", ignorenulls=True).over(wb).alias(f"_o_{n}") for n in last],
            *[F.first(f"_s_{n}", ignorenulls=True).over(wa).alias(f"_o_{n}") for n in first],
        )
        out = self._attach(carried).withColumns({n: F.coalesce(c, F.col(f"_o_{n}")) for n, c in local.items()})
        return self._with(out.drop(*[f"_o_{n}" for n in local]))


    def least_ahead(self, mins: Mapping[str, Column]) -> "Ordered":
        """Smallest value from the row to the end of the key."""
        ahead = self.backwards.rowsBetween(Window.unboundedPreceding, 0)
        local = {n: F.min(e).over(ahead) for n, e in mins.items()}
        if not self.chunked:
            return self._with(self._df.withColumns(local))
        w = self._chunk_window().rowsBetween(1, Window.unboundedFollowing)
        ends = self._df.groupBy(*self.group).agg(*[F.min(e).alias(f"_s_{n}") for n, e in mins.items()])
        later = ends.select(*self.group, *[F.min(f"_s_{n}").over(w).alias(f"_o_{n}") for n in mins])
        out = self._attach(later).withColumns({n: F.least(c, F.col(f"_o_{n}")) for n, c in local.items()})
        return self._with(out.drop(*[f"_o_{n}" for n in mins]))


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one row per key to a large table.

    No hint: below the broadcast threshold the planner broadcasts the lookup,
    above it the adaptive skew join splits a hot key of the large side.
    """
    return df.join(per_key, list(keys), how)


def broadcast_if_small(per_key: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """A derived lookup table, computed once and sent to every task if it is small.

    Without this the planner cannot know its size in advance and shuffles the large
    side by a key that may have very few values.  Above the limit it is checkpointed
    and left to the (skew-aware) shuffled join.
    """
    spark = per_key.sparkSession
    rows = per_key.limit(settings.broadcast_rows + 1).collect()
    if len(rows) <= settings.broadcast_rows:
        return F.broadcast(spark.createDataFrame(rows, per_key.schema))
    checkpoint_dir(spark)
    return per_key.checkpoint()


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Distinct values with their count (and summed weight): ties leave one row."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if weight is not None:
        aggs.append(F.sum(weight).alias("w"))
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*aggs)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], settings: Settings = DEFAULT
) -> DataFrame:
    """Exact linear-interpolated quantiles per key for groups of any size."""
    counts = value_counts(df, keys, value)
    ranked = Ordered(counts, keys, [value], settings).running({"_cum": F.col("n")}).df
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_n"))
    ranked = attach(ranked, totals, keys) if keys else ranked.join(F.broadcast(totals))
    lo, hi = F.col("_cum") - F.col("n"), F.col("_cum") - 1
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        v = F.col(value).cast("double")
        for part, rank in (("_f", F.floor(pos)), ("_c", F.ceil(pos))):
            aggs.append(F.max(F.when((rank >= lo) & (rank <= hi), v)).alias(name + part))
        aggs.append(F.max(pos - F.floor(pos)).alias(name + "_w"))
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[
            (F.col(n + "_f") + (F.col(n + "_c") - F.col(n + "_f")) * F.col(n + "_w")).alias(n)
            for n in probs
        ],
    )


def kth_smallest(df: DataFrame, keys: Sequence[str], value: str, k: Column, name: str, settings: Settings = DEFAULT):
    """The k-th smallest value of each key; ``k`` may use any column of ``keys`` rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"), F.first(k).alias("_k")
    )
    ranked = Ordered(counts, keys, [value], settings).running({"_cum": F.col("_n")}).df
    hit = (F.col("_k") <= F.col("_cum")) & (F.col("_k") > F.col("_cum") - F.col("_n"))
    return ranked.groupBy(*keys).agg(F.max(F.when(hit, F.col(value))).alias(name))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, settings: Settings = DEFAULT) -> DataFrame:
    """(keys, value, n, rank): tie-aware mean rank of every distinct value."""
    counts = value_counts(df, keys, value)
    ranked = Ordered(counts, keys, [value], settings).running({"_cum": F.col("n")}).df
    return ranked.withColumn("rank", F.col("_cum") - (F.col("n") - 1) / 2.0).drop("_cum")
