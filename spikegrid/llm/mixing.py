"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix is the golden-ratio point frac(i * phi), in 32-bit fixed point,
mapped through the cumulative target shares to a source. The r-th slot of a source is
the r-th block of equal word count in its stream: its documents in hashed order, read
again from the start when used up, at most ``repeats`` times.

The number of slots is a parameter, so every table below except the documents and
their pieces is bounded by it or by the number of sources. A source's taken words lie
within a few blocks (words / slots each) of its target. Where that is more than 1 / ``NEAR``
of the target (small sources beside large ones), the source's slots share its target
equally, so that its taken words are its target rounded; without a slot of its own it
shares the slot of the next point.

Nulls: a null text has no words; a null source is one source, last in order. Documents
without words are never taken. Repeated rows are separate documents. An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikegrid.llm.common import WORD, saved, with_running

WEIGHTS = (5, 2, 1)
REPEATS = 3
SLOTS = 1 << 17
GOLDEN = 2654435769          # 2^32 divided by the golden ratio
NEAR = 200
ROWS_PER_PIECE = 100_000


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_no, source_size, target, all_words): one row for each source.

    Weights repeat over the sources in code point order, null last. A source gets
    weight * level, but at most ``repeats`` times its size; the level is such that the
    targets sum to the size of all sources."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sums.withColumn("source_no", F.row_number().over(number))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    sums = sums.withColumns({"_w": weight, "_most": F.col("source_size") * repeats})
    by_ratio = Window.orderBy(F.col("_most") / F.col("_w"), "source_no")
    everything = Window.partitionBy()
    sums = sums.withColumns({
        "all_words": F.sum("source_size").over(everything),
        "_capped_before": F.coalesce(F.sum("_most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_w_left": F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    sums = sums.withColumn("_capped", F.col("_most") * F.col("_w_left") <= (F.col("all_words") - F.col("_capped_before")) * F.col("_w"))
    sums = sums.withColumns({
        "_taken": F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_most"))).over(everything), F.lit(0)),
        "_rest": F.coalesce(F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(everything), F.lit(1)),
    })
    share = (F.col("_w") * (F.col("all_words") - F.col("_taken"))).cast("double") / F.col("_rest")
    return sums.select("source", "source_no", "source_size", "all_words",
                       F.when(F.col("_capped"), F.col("_most").cast("double")).otherwise(share).alias("target"))


def schedule(sources: DataFrame, block: int, slots: int) -> DataFrame:
    """(source_no, rank, slot): the source of each slot and the slot's number within it.
    A source that no point falls to has the slot of the first point behind its start."""
    whole = 1 << 32
    below = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = sources.where("target > 0").select(
        F.floor(F.coalesce(F.sum("target").over(below), F.lit(0.0)) * whole / F.sum("target").over(everything)).alias("_x"),
        F.lit(-1).cast("long").alias("slot"), "source_no")
    points = sources.sparkSession.range(slots).select(
        ((F.col("id") * GOLDEN) % whole).alias("_x"), F.col("id").alias("slot"), F.lit(None).cast("int").alias("source_no"))
    # each point belongs to the last start at or below it; bounded by slots + sources rows
    order = Window.orderBy("_x", "slot", F.col("source_no").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.orderBy(F.col("_x").desc(), F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.unionByName(points).withColumns({
        "source_no": F.last("source_no", True).over(order),
        "_next": F.coalesce(F.last(F.when(F.col("slot") >= 0, F.col("slot")), True).over(back), F.lit(slots - 1))})
    carried = carried.withColumn("_most", F.max("slot").over(Window.partitionBy("source_no")))
    carried = carried.withColumn("slot", F.when(F.col("_most") < 0, F.col("_next")).otherwise(F.col("slot"))).where("slot >= 0")
    rank = F.row_number().over(Window.partitionBy("source_no").orderBy("slot")) - 1
    return carried.select("source_no", rank.cast("long").alias("rank"), "slot")


def shares(sources: DataFrame, slots: DataFrame, block: int, repeats: int) -> DataFrame:
    """(source_no, own_block, goal): the words that each slot of a source takes, and all of them."""
    n = slots.groupBy("source_no").agg(F.count(F.lit(1)).alias("_n"))
    by_blocks = F.least(F.col("_n") * block, F.col("source_size") * repeats)
    far = F.abs(by_blocks - F.col("target")) * NEAR > F.col("target")
    exact = F.greatest(F.lit(1), F.round("target").cast("long"))
    out = sources.join(n, "source_no").withColumn("goal", F.when(far, exact).otherwise(by_blocks))
    return out.select("source_no", F.when(far, F.ceil(F.col("goal") / F.col("_n"))).otherwise(F.lit(block)).cast("long").alias("own_block"), "goal")


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, slots: int = SLOTS,
        seed: int = 0, rows_per_piece: int = ROWS_PER_PIECE) -> tuple[DataFrame, DataFrame]:
    """``rows`` (row_id, source, size). Returns the rows with source_size and target,
    and the mix itself: (row_id, slot, from_word, words), the words of a row that
    a slot of the schedule takes."""
    sources = saved(targets(rows, weights, repeats), "mix-sources")
    head = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    words, n = head[0] or 0, head[1] or 0
    block = max(1, -(-words // slots))
    count = -(-words // block)
    docs = rows.join(sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target"),
                     F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    digits = max(1, len(f"{n // rows_per_piece:x}"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("row_id").cast("string"), F.lit(""))).cast("binary"))
    stream = docs.where("size > 0").withColumn("_order", order).withColumn("_piece", F.substring("_order", 1, digits))
    stream = with_running(stream, ["source_no"], "_piece", [F.col("_order"), F.col("row_id"), F.col("size")], "size", "_at")
    stream = stream.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    start = F.col("_at") + F.col("_round") * F.col("source_size")
    slots_of = saved(schedule(sources, block, count), "mix-slots")
    stream = stream.join(F.broadcast(shares(sources, slots_of, block, repeats)), "source_no")
    stream = stream.withColumn("_start", start).where(F.col("_start") < F.col("goal"))
    stop, own = F.least(F.col("_start") + F.col("size"), F.col("goal")), F.col("own_block")
    stream = stream.withColumn("rank", F.explode(F.sequence(F.floor(F.col("_start") / own), F.floor((stop - 1) / own))))
    low = F.greatest(F.col("_start"), F.col("rank") * own)
    high = F.least(stop, (F.col("rank") + 1) * own)
    taken = stream.join(slots_of, ["source_no", "rank"]).select(
        "row_id", "slot", (low - F.col("_start")).alias("from_word"), (high - low).alias("words"))
    return docs, taken


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    return mixed(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # equal (doc_id, source, size) rows are told apart, so that each is taken by itself
    again = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0)))
    rows = rows.withColumn("_copy", again)
    rows = saved(rows.select("doc_id", "source", "size", F.concat_ws(
        "/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_copy", "size", "source").alias("row_id")), "mix-rows")
    out, taken = mix(rows, **options)
    sums = taken.groupBy("row_id").agg(F.sum("words").alias("taken"))
    return out.join(sums, "row_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def first_words(n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, n), "")


def take_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row as often as all its words are taken (0 to
    ``repeats`` times), and once more with the first words for what is taken beyond
    that, so each source has the words the mix takes of it. n_chars, if there is such a
    column, is that of the text. Rows of one id, source and size share what is taken of them."""
    def key(size: str) -> Column:
        return F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), size, F.col("source").isNull().cast("string"), "source")

    m = mixed(docs, **options).groupBy(key("size").alias("__mix_key")).agg(
        F.first("size").cast("long").alias("__mix_size"), F.sum("taken").alias("__mix_taken"), F.count(F.lit(1)).alias("__mix_rows"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumn("__mix_n", size).withColumn("__mix_key", key("__mix_n")).join(m.where("__mix_taken > 0"), "__mix_key")
    number = F.row_number().over(Window.partitionBy("__mix_key").orderBy(F.xxhash64("text")))
    whole = F.floor(F.col("__mix_taken") / F.col("__mix_size"))
    rows = rows.withColumns({"__mix_no": number - 1, "__mix_whole": whole, "__mix_rest": F.col("__mix_taken") - whole * F.col("__mix_size")})
    more = F.col("__mix_whole") % F.col("__mix_rows")
    rows = rows.withColumns({
        "__mix_times": F.floor(F.col("__mix_whole") / F.col("__mix_rows")) + (F.col("__mix_no") < more).cast("long"),
        "__mix_rest": F.when(F.col("__mix_no") == more, F.col("__mix_rest")).otherwise(0).cast("int")})
    rows = rows.withColumn("__mix_last", F.col("__mix_times") + (F.col("__mix_rest") > 0).cast("long")).where("__mix_last > 0")
    rows = rows.withColumn("__mix_t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_last"))))
    cut = F.col("__mix_t") > F.col("__mix_times")
    rows = rows.withColumn("text", F.when(cut, first_words(F.col("__mix_rest"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
