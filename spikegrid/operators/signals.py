"""Field-potential operators over ``lfp(keys..., i, v)``, i = sample number from 0.

A signal is cut into blocks of consecutive samples; one row holds one block.  The
recursions are linear, so a block is filtered from state zero, the (small) states
are chained per signal, and a second pass starts every block from its true state.
Signals of any length are spread over tasks that way.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikegrid.functions.filters import StateFilter, dc_blocker, design
from spikegrid.operators.ordered import Ordered, attach
from spikegrid.session import computed_once
from spikegrid.settings import DEFAULT, Settings


def every_kth(lfp: DataFrame, rate: float, target: float) -> DataFrame:
    """Keep every int(rate / target)-th sample."""
    k = int(rate / target)
    if k < 1:
        raise ValueError("the target rate must not exceed the sampling rate")
    return lfp.where(F.col("i") % k == 0).withColumn("i", F.floor(F.col("i") / k))


def in_blocks(lfp: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """keys, block, n_blocks, n, x (samples in order); a block has length .. 2 length - 1 samples."""
    per = lfp.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("n_blocks", F.greatest(F.floor(F.col("n") / length), F.lit(1)))
    b = F.least(F.floor(F.col("i") / length), F.col("n_blocks") - 1)
    return (
        attach(lfp, per, keys)
        .groupBy(*keys, b.alias("block"))
        .agg(F.first("n").alias("n"), F.first("n_blocks").alias("n_blocks"),
             F.sort_array(F.collect_list(F.struct("i", F.col("v").cast("double").alias("v")))).alias("_s"))
        .select(*keys, "block", "n_blocks", "n", F.col("_s.v").alias("x"))
    )


def _chained(blocks: DataFrame, keys: Sequence[str], first: str, backward: bool, flt: StateFilter) -> DataFrame:
    """Start state of every block: s' = A^len s + end, from ``first`` state on, in time or against it.
    A signal of one block starts from its first state; only longer ones are gathered."""
    kinds = dict(blocks.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block long, start array<double>"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=not backward)
        s, starts, powers = np.asarray(pdf[first].iloc[0], float), [], {}
        for end, m in zip(pdf["end"], pdf["len"]):
            starts.append(s)
            if m not in powers:
                powers[m] = flt.power(m)
            s = powers[m] @ s + np.asarray(end, float)
        out = pdf[[*keys, "block"]].copy()
        out["start"] = starts
        return out

    # one short row per block of samples
    longer = blocks.where("n_blocks > 1").select(*keys, "block", first, "end", "len").groupBy(*keys).applyInPandas(fold, schema)
    return blocks.where("n_blocks = 1").select(*keys, "block", F.col(first).alias("start")).unionByName(longer)


def zero_phase(lfp: DataFrame, keys: Sequence[str], b, a, settings: Settings = DEFAULT) -> DataFrame:
    """Forward and backward filtering with odd extension at both ends (column ``y``)."""
    flt = StateFilter(b, a)
    pad = 3 * max(len(a), len(b))
    settled = flt.settled()
    length = max(settings.samples_per_kernel, pad + 1)
    blocks = in_blocks(lfp, keys, length)

    def extended(x, is_first, is_last):
        x = np.asarray(x, float)
        if is_first and is_last and len(x) <= pad:
            raise ValueError(f"a signal needs more than {pad} samples for this filter")
        parts = [2 * x[0] - x[pad:0:-1]] if is_first else []
        parts.append(x)
        if is_last:
            parts.append(2 * x[-1] - x[-2:-pad - 2:-1])
        return np.concatenate(parts)

    @F.pandas_udf("struct<end:array<double>,zi:array<double>,len:long>")
    def probe(x: pd.Series, block: pd.Series, n_blocks: pd.Series) -> pd.DataFrame:
        out = []
        for v, k, m in zip(x, block, n_blocks):
            e = extended(v, k == 0, k == m - 1)
            out.append((flt.run(e, np.zeros(flt.n))[1], settled * e[0], len(e)))
        return pd.DataFrame(out, columns=["end", "zi", "len"])

    @F.pandas_udf("array<double>")
    def forward(x: pd.Series, start: pd.Series, block: pd.Series, n_blocks: pd.Series) -> pd.Series:
        return pd.Series([flt.run(extended(v, k == 0, k == m - 1), np.asarray(s, float))[0]
                          for v, s, k, m in zip(x, start, block, n_blocks)])

    @F.pandas_udf("struct<end:array<double>,zi:array<double>>")
    def probe_back(y: pd.Series) -> pd.DataFrame:
        out = []
        for v in y:
            r = np.asarray(v, float)[::-1]
            out.append((flt.run(r, np.zeros(flt.n))[1], settled * r[0]))
        return pd.DataFrame(out, columns=["end", "zi"])

    @F.pandas_udf("array<double>")
    def backward(y: pd.Series, start: pd.Series, block: pd.Series, n_blocks: pd.Series) -> pd.Series:
        out = []
        for v, s, k, m in zip(y, start, block, n_blocks):
            r = flt.run(np.asarray(v, float)[::-1], np.asarray(s, float))[0][::-1]
            out.append(r[pad if k == 0 else 0: len(r) - (pad if k == m - 1 else 0)])
        return pd.Series(out)

    at = [*keys, "block"]
    p = blocks.select(*at, "n_blocks", probe("x", "block", "n_blocks").alias("_p")).select(*at, "n_blocks", "_p.*")
    y = blocks.join(_chained(p, keys, "zi", False, flt), at)
    # the forward pass feeds two branches: write it once instead of filtering twice
    y = computed_once(y.select(*at, "n_blocks", forward("x", "start", "block", "n_blocks").alias("y")))
    q = y.select(*at, "n_blocks", F.size("y").cast("long").alias("len"), probe_back("y").alias("_p")).select(*at, "n_blocks", "len", "_p.*")
    out = y.join(_chained(q, keys, "zi", True, flt), at).select(*at, backward("y", "start", "block", "n_blocks").alias("y"))
    return out.select(*keys, (F.col("block") * length).alias("_o"), F.posexplode_outer("y").alias("_i", "y")).where("_i IS NOT NULL").select(
        *keys, (F.col("_o") + F.col("_i")).alias("i"), "y")


def iir(lfp: DataFrame, keys: Sequence[str], rate: float, band: str, low: float, high: float | None = None, order: int = 3,
        kind: str = "butter", rp: float = 3.0, rs: float = 60.0, settings: Settings = DEFAULT) -> DataFrame:
    """Zero-phase low, high or band pass of one of the five classic families."""
    edges = low / (rate / 2) if high is None else [low / (rate / 2), high / (rate / 2)]
    return zero_phase(lfp, keys, *design(order, edges, band, kind, rp, rs), settings)


def notch(lfp: DataFrame, keys: Sequence[str], rate: float, freq: float = 60.0, width: float = 10.0, order: int = 2,
          kind: str = "butter", ripple: float = 1.0, settings: Settings = DEFAULT) -> DataFrame:
    """Band stop of ``width`` around ``freq``."""
    edges = [(freq - width / 2) / (rate / 2), (freq + width / 2) / (rate / 2)]
    return zero_phase(lfp, keys, *design(order, edges, "stop", kind, ripple), settings)


def chebyshev_band(lfp: DataFrame, keys: Sequence[str], rate: float, order: int, ripple: float, low: float, high: float,
                   settings: Settings = DEFAULT) -> DataFrame:
    return iir(lfp, keys, rate, "band", low, high, order, "cheby1", ripple, settings=settings)


def block_dc(lfp: DataFrame, keys: Sequence[str], rate: float, cutoff: float, settings: Settings = DEFAULT) -> DataFrame:
    return zero_phase(lfp, keys, *dc_blocker(2 * cutoff / rate), settings)


# ------------------------------------------------------------------ spectrum
def spectrum(lfp: DataFrame, keys: Sequence[str], rate: float, settings: Settings = DEFAULT) -> DataFrame:
    """One-sided amplitude 2/N |X_k| at k rate / N, k < N/2.

    Signals up to ``samples_per_kernel`` are transformed in one task each; longer
    ones by a transform of square-root sized pieces over two shuffles.
    """
    per = lfp.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    longest = per.agg(F.max("n")).first()[0] or 0
    tagged = attach(lfp, per, keys)
    small = tagged.where(F.col("n") <= settings.samples_per_kernel)
    packed = small.groupBy(*keys).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", F.col("v").cast("double").alias("v")))).alias("_s"))

    @F.pandas_udf("array<double>")
    def amplitude(x: pd.Series) -> pd.Series:
        return pd.Series([2.0 / len(v) * np.abs(np.fft.fft(np.asarray(v, float))[: len(v) // 2]) for v in x])

    out = packed.select(*keys, "n", F.posexplode_outer(amplitude(F.col("_s.v"))).alias("k", "amplitude")).where("k IS NOT NULL")
    if longest > settings.samples_per_kernel:
        out = out.unionByName(_long_spectrum(tagged.where(F.col("n") > settings.samples_per_kernel), keys, longest))
    return out.select(*keys, F.col("k").cast("long").alias("k"), (F.col("k") * F.lit(float(rate)) / F.col("n")).alias("frequency"), "amplitude")


def _power_fft(df: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """Transform of length 2^bits of rows (keys, i, re, im); absent rows are 0.

    Index i = n2 + N2 n1: pieces of equal n2 are transformed and turned, then
    pieces of equal k1; result index k = k1 + N1 k2.
    """
    n1, n2 = 1 << (bits // 2), 1 << (bits - bits // 2)
    kinds = dict(df.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    total = n1 * n2

    def piece(length, pos):
        def load(pdf):
            x = np.zeros(length, dtype=complex)
            x[pdf[pos].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
            return x
        return load

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["_b"].iloc[0])
        k = np.arange(n1)
        y = np.fft.fft(piece(n1, "_a")(pdf)) * np.exp(-2j * np.pi * ((b * k) % total) / total)
        out = pd.DataFrame({"_b": b, "_k": k, "re": y.real, "im": y.imag})
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "_b", "_k", "re", "im"]]

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        k1 = int(pdf["_k"].iloc[0])
        y = np.fft.fft(piece(n2, "_b")(pdf))
        out = pd.DataFrame({"i": k1 + n1 * np.arange(n2, dtype=np.int64), "re": y.real, "im": y.imag})
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "i", "re", "im"]]

    cut = df.select(*keys, (F.col("i") % n2).alias("_b"), F.floor(F.col("i") / n2).alias("_a"), "re", "im")
    one = cut.groupBy(*keys, "_b").applyInPandas(first, f"{head}, _b long, _k long, re double, im double")
    return one.groupBy(*keys, "_k").applyInPandas(second, f"{head}, i long, re double, im double")


def _long_spectrum(tagged: DataFrame, keys: Sequence[str], longest: int) -> DataFrame:
    """Chirp transform: a length-N spectrum as a circular convolution of length 2^bits."""
    bits = max(2, int(2 * longest - 1).bit_length())
    size = 1 << bits
    pi = float(np.pi)

    def chirp(n):
        # n^2 mod 2N in exact integers
        sq = F.pmod(F.col(n).cast("decimal(19,0)") * F.col(n).cast("decimal(19,0)"), (2 * F.col("n")).cast("decimal(19,0)"))
        return F.lit(pi) * sq.cast("double") / F.col("n")

    lens = tagged.select(*keys, "n").distinct()
    x = tagged.select(*keys, "n", "i", F.col("v").cast("double").alias("v")).withColumn("_p", chirp("i"))
    a = x.select(*keys, F.col("i").cast("long").alias("i"), (F.col("v") * F.cos("_p")).alias("re"), (-F.col("v") * F.sin("_p")).alias("im"))
    w = tagged.select(*keys, "n", F.col("i").cast("long").alias("i")).withColumn("_p", chirp("i"))
    w = w.withColumn("i", F.explode(F.when(F.col("i") == 0, F.array(F.col("i"))).otherwise(F.array(F.col("i"), F.lit(size) - F.col("i")))))
    b = w.select(*keys, "i", F.cos("_p").alias("re"), F.sin("_p").alias("im"))
    fa, fb = _power_fft(a, keys, bits), _power_fft(b, keys, bits)
    fb = fb.select(*keys, "i", F.col("re").alias("_re"), F.col("im").alias("_im"))
    # inverse transform through the conjugate
    prod = fa.join(fb, [*keys, "i"]).select(
        *keys, "i", (F.col("re") * F.col("_re") - F.col("im") * F.col("_im")).alias("re"),
        (-(F.col("re") * F.col("_im") + F.col("im") * F.col("_re"))).alias("im"))
    c = attach(_power_fft(prod, keys, bits), lens, keys).where(F.col("i") < F.floor(F.col("n") / 2))
    amp = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.lit(float(size))
    return c.select(*keys, "n", F.col("i").alias("k"), (amp * 2.0 / F.col("n")).alias("amplitude"))


# ------------------------------------------------------------ adaptive rate
def adaptive_rate(spk: DataFrame, keys: Sequence[str], window: float, settings: Settings = DEFAULT) -> DataFrame:
    """Rate over windows that grow until they exceed ``window`` seconds, then restart.

    A window ends at the first spike more than ``window`` after its start, so the ends
    form a chain.  Per chunk every possible entry (a spike within ``window`` of the
    chunk start) is followed to the chunk's last end; the chunks are then linked
    through those few entries, and each chunk lists its own ends.
    Result: keys, t (middle), rate.
    """
    o = Ordered(spk, keys, ["t", "i"], settings).number("_k")
    d = o._df if o.chunked else o._df.withColumn("_chunk", F.lit(-1))
    group = [*keys, "_chunk"]
    kinds = dict(d.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in group)

    def following(t: np.ndarray) -> list[int]:
        return np.searchsorted(t, t + window, side="right").tolist()

    def ends_from(after: list[int], start: int) -> list[int]:
        out = [start]
        while after[out[-1]] < len(after):
            out.append(after[out[-1]])
        return out

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.sort_values(["t", "i"])["t"].to_numpy()
        after, leave = following(t), list(range(len(t)))
        for e in range(len(t) - 1, -1, -1):             # the last end on the way from each spike
            if e < after[e] < len(t):
                leave[e] = leave[after[e]]
        entries = range(int(np.searchsorted(t, t[0] + window, side="right")) + 1)
        rows = [(t[e], t[leave[e]]) for e in entries if e < len(t)]
        out = pd.DataFrame(rows, columns=["entry", "leave"])
        out["_n"] = np.arange(len(out))
        for c in group:
            out[c] = pdf[c].iloc[0]
        return out[[*group, "_n", "entry", "leave"]]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, last = [], None
        for chunk, part in pdf.sort_values(["_chunk", "_n"]).groupby("_chunk", sort=True):
            if last is None:
                hit = part.iloc[0]
            else:
                ok = part[part["entry"] > last + window]
                if ok.empty:
                    continue
                hit = ok.iloc[0]
            rows.append((chunk, int(hit["_n"])))
            last = hit["leave"]
        out = pd.DataFrame(rows, columns=["_chunk", "_n"])
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "_chunk", "_n"]]

    @F.pandas_udf("array<int>")
    def mark(t: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([ends_from(following(np.asarray(v, float)), int(n)) for v, n in zip(t, start)])

    if o.chunked:
        entries = d.select(*group, "t", "i").groupBy(*group).applyInPandas(table, f"{head}, _n long, entry double, leave double")
        start = entries.groupBy(*keys).applyInPandas(link, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, _chunk {kinds['_chunk']}, _n long")
        d = d.join(start, group)
    else:
        d = d.withColumn("_n", F.lit(0).cast("long"))
    # a chunk is one packed row, spikes without a time at its end
    spikes = F.sort_array(F.collect_list(F.struct(F.col("t").isNull().alias("_none"), F.col("t").cast("double").alias("t"), "i", "_k")))
    packed = d.groupBy(*group).agg(spikes.alias("_s"), F.first("_n").alias("_n"))
    packed = packed.select(*group, "_s", mark(F.col("_s.t"), F.col("_n")).alias("_ends"))
    ends = packed.select(*group, F.explode_outer(F.transform("_ends", lambda j: F.get("_s", j))).alias("_e")).where("_e IS NOT NULL")
    ends = ends.select(*group, "_e.t", "_e._k")
    # ends are far fewer than spikes; their neighbours give counts and durations
    e = Ordered(ends.drop("_chunk").withColumn("i", F.col("_k")), keys, ["t", "i"], settings)
    e = e.lag_lead({"_pt": ("t", -1), "_pk": ("_k", -1)})
    span = F.col("t") - F.col("_pt")
    n = F.col("_k") - F.col("_pk") + F.when(F.col("_pk") == 1, 1).otherwise(0)
    return e.df.where(F.col("_pt").isNotNull()).select(*keys, ((F.col("t") + F.col("_pt")) / 2).alias("t"), (n / span).alias("rate"), n.alias("n"))
