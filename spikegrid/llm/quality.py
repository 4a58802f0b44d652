"""Quality rules: text statistics, base rules, and robust multivariate outliers.

Statistics are array expressions on each row; n-gram repeats are found by sorting the
hashes of the row's own windows, so a text of n words costs n log n, and nothing of a
text leaves its row.

Outliers: per (language, source), a minimum-covariance-determinant estimate of five
transformed statistics. Starting from medians and median deviations, each concentration
step takes the ``share`` of rows nearest by Mahalanobis distance (a count of distance
bins finds the border) and takes their mean and covariance. Steps are grouped sums of
whole numbers, so any order of tasks gives the same result. The scatter of small groups
leans on that within all groups, as if they held ``PRIOR`` rows more. A row is rejected if its
distance exceeds ``cutoff``.

Nulls: a null text has no words and fails the base rules; null and empty language or
source are one group. Ties have equal distances, so equal verdicts within a group.
Repeated rows are judged each. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikegrid.llm.common import SPACES, WORD, saved

SYMBOLS = "#*$%&|<>"
WINDOW = 5
FEATURES = 5
SCALE = 1024             # steps of a standardised statistic
RANGE = 16               # standardised statistics are cut off here
STEPS = 4
SHARE = 0.75
CONSISTENCY = 1.41       # for 5 statistics and a share of 0.75: 0.75 / P(chi2_7 < q), q the 0.75 quantile of chi2_5
PRIOR = 200
FLOOR = 0.15             # least standard deviation of a standardised statistic
CUTOFF = 200.0           # squared distance; texts are not normal, so far above the chi-square quantiles
BINS_PER_UNIT = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the row."""
    def covered(at: Column) -> Column:
        # sorted starts: each adds the words up to the next start, the last a whole window
        steps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(F.lit(window), b - a))
        return F.aggregate(steps, F.lit(window), lambda s, x: s + x)

    def starts(cells: Column) -> Column:
        # neighbours in hash order with equal hashes
        n = F.size(cells)
        near = F.zip_with(F.slice(cells, 2, n), F.slice(cells, 1, n - 1), lambda b, a: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull()))))

    def of(hashes: Column) -> Column:
        cells = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(twice, _let(_let(cells, starts), covered)).otherwise(F.lit(0))

    def windows(h: Column) -> Column:
        # one array for each place in the window, shifted, hashed together
        n = F.size(h) - (window - 1)
        shifted = F.arrays_zip(*[F.slice(h, k + 1, n).alias(f"w{k}") for k in range(window)])
        return F.when(n > 1, _let(F.transform(shifted, lambda x: F.xxhash64(x)), of)).otherwise(F.lit(0))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """(carry, doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    dup = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    found = F.struct(*[c.cast("long").alias(n) for c, n in (
        (F.length(F.translate(text, SPACES, "")), "word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, "")), "n_symbols"),
        (dup, "n_dup_lines"))])
    counted = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")))
    rows = docs.select(*carry, "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                       counted.alias("_w"), found.alias("_s"))
    return rows.select(*carry, "doc_id", "lang", "source", F.col("_w.n").alias("n_words"), "_s.*", F.col("_w.r").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def transformed() -> list[Column]:
    """Five statistics on scales where usual texts spread evenly; counts of short texts
    are drawn towards usual values, as if they had some words more."""
    n = F.col("n_words").cast("double")
    chars = F.col("word_chars").cast("double")
    return [F.log(n + 20) * 0.6, (chars + 300) / (n + 60) * 2.0, F.sqrt(F.col("n_symbols") / (chars + 200)) * 12.0,
            F.log1p(F.col("n_dup_lines") * 40 / (n + 40)) * 3.0, F.sqrt(F.col("n_repeat_words") / (n + 20)) * 4.0]


def _long(x: Column) -> Column:
    return F.round(x * SCALE).cast("long")


def _medians(rows: DataFrame, keys: list[str], values: list[Column]) -> DataFrame:
    """Exact lower medians by counting values: (keys, m0..)."""
    cells = rows.select(*keys, F.posexplode(F.array(*values)).alias("j", "x")).groupBy(*keys, "j", "x").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys, "j").orderBy("x")
    cells = cells.withColumns({"_up": F.sum("c").over(upto), "_all": F.sum("c").over(Window.partitionBy(*keys, "j"))}).where(F.col("_up") * 2 >= F.col("_all"))
    lows = cells.groupBy(*keys, "j").agg(F.min("x").alias("m"))
    return lows.groupBy(*keys).agg(*[F.max(F.when(F.col("j") == j, F.col("m"))).alias(f"m{j}") for j in range(len(values))])


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(FEATURES) for j in range(i + 1)]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(FEATURES)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _pairs()]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def _whitened(moments: DataFrame, factor: float) -> DataFrame:
    """Mean and Cholesky factor of each group. Its covariance is mixed with that within
    all groups, as of ``PRIOR`` rows more, and times ``factor``; unrolled as columns."""
    n = F.col("n").cast("double")
    m = moments.withColumns({f"mean{i}": F.col(f"s{i}") / n for i in range(FEATURES)})
    m = m.withColumns({f"w{i}{j}": F.col(f"p{i}{j}") - F.col(f"mean{i}") * F.col(f"s{j}") for i, j in _pairs()})
    # one row for each group, added up in a fixed order
    every = Window.orderBy("lang", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = m.withColumn("all_n", F.sum("n").over(every)).withColumns({f"all{i}{j}": F.sum(f"w{i}{j}").over(every) for i, j in _pairs()})
    m = m.withColumns({f"c{i}{j}": (F.col(f"w{i}{j}") + F.col(f"all{i}{j}") / F.col("all_n") * PRIOR) / (n + PRIOR) * factor
                       + (F.lit((FLOOR * SCALE) ** 2) if i == j else F.lit(0.0)) for i, j in _pairs()})
    for i in range(FEATURES):                                  # Cholesky, row by row
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            m = m.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    return m.select("lang", "source", *[f"mean{i}" for i in range(FEATURES)], *[f"l{i}{j}" for i, j in _pairs()])


def _with_distance(rows: DataFrame, models: DataFrame, how: str = "inner") -> DataFrame:
    """Squared distance by forward substitution."""
    out = rows.join(models, ["lang", "source"], how)
    for i in range(FEATURES):
        rest = F.col(f"x{i}") - F.col(f"mean{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for i in range(FEATURES):
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return out.withColumn("distance", total).select(*rows.columns, "distance")


def models(rows: DataFrame, steps: int = STEPS, share: float = SHARE) -> DataFrame:
    """Centre and scatter of each (lang, source); ``rows`` has whole-number x0..x4."""
    keys = ["lang", "source"]
    xs = [F.col(f"x{i}") for i in range(FEATURES)]
    centre = _medians(rows, keys, xs)
    away = rows.join(centre, keys)
    spread = _medians(away, keys, [F.abs(F.col(f"x{i}") - F.col(f"m{i}")) for i in range(FEATURES)]).select(*keys, *[F.col(f"m{i}").alias(f"d{i}") for i in range(FEATURES)])
    start = centre.join(spread, keys)
    scale = [F.col(f"d{i}") * 1.4826 + FLOOR * SCALE for i in range(FEATURES)]
    model = start.select(*keys, *[F.col(f"m{i}").cast("double").alias(f"mean{i}") for i in range(FEATURES)],
                         *[(scale[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _pairs()])
    model = saved(model, "quality-models")
    for _ in range(steps):
        near = _with_distance(rows, model).withColumn("bin", F.floor(F.log1p("distance") * BINS_PER_UNIT))
        # sums by distance bin: the bins below the border add up to the concentrated moments
        cells = saved(_moments(near, keys + ["bin"]), "quality-cells")
        upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        chosen = cells.withColumns({"_before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "_all": F.sum("n").over(Window.partitionBy(*keys))})
        chosen = chosen.where(F.col("_before") < F.ceil(F.col("_all") * share))
        names = ["n"] + [f"s{i}" for i in range(FEATURES)] + [f"p{i}{j}" for i, j in _pairs()]
        moments = chosen.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
        model = saved(_whitened(moments, CONSISTENCY), "quality-models")
    return model


def _measured(docs: DataFrame, *carry: str) -> DataFrame:
    """The statistics with base_failed and the transformed ones as whole numbers x0..x4."""
    rows = statistics(docs, *carry).withColumn("base_failed", base_failed())
    fixed = [_long(F.least(F.lit(float(RANGE)), F.greatest(F.lit(-float(RANGE)), x))) for x in transformed()]
    return rows.withColumns({f"x{i}": x for i, x in enumerate(fixed)})


def _judged(rows: DataFrame, model: DataFrame, cutoff: float) -> DataFrame:
    """Adds kept and distance. Groups of rows that all fail the base rules have no model."""
    out = _with_distance(rows, model, "left")
    distance = F.when(~F.col("base_failed"), F.col("distance"))
    return out.withColumn("distance", distance).withColumn("kept", F.coalesce(F.col("distance") <= cutoff, F.lit(False)))


def judged(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)."""
    rows = saved(_measured(docs), "quality-rows")
    out = _judged(rows, models(rows.where("NOT base_failed"), steps), cutoff)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "distance", "lang", "source")


def verdicts(docs: DataFrame, **options) -> DataFrame:
    return judged(docs, **options).drop("distance", "lang", "source")


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """The rows that are kept. Texts are measured again beside the finished models, so
    that no text is shuffled."""
    rows = saved(_measured(docs).drop("doc_id"), "quality-rows")
    model = models(rows.where("NOT base_failed"), steps)
    marked = docs.select("doc_id", "text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    kept = _judged(_measured(marked, "__row"), model, cutoff).where("kept")
    return kept.select("__row.*")
