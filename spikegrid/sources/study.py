"""From a folder of recordings to the base tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spikegrid.functions.expr import safe_div
from spikegrid.operators.ordered import Ordered, attach
from spikegrid.operators.reports import first_of_copies
from spikegrid.operators.spikes import valid_cells
from spikegrid.operators.tracking import boxcar, drop_jumps, repair_time, strip_trailing_missing, to_cm
from spikegrid.settings import DEFAULT, Settings
from spikegrid.sources.formats import register


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files by kind: pos, cut, matched, set, tetrode (last digit = tetrode number)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")
    kind = (
        F.when(F.col("path").rlike(r"_matched\.cut$"), "matched").when(F.col("path").rlike(r"\.cut$"), "cut")
        .when(F.col("path").rlike(r"\.pos$"), "pos").when(F.col("path").rlike(r"\.set$"), "set")
        .when(F.col("path").rlike(r"\.[0-9]+$"), "tetrode")
    )
    return f.withColumn("kind", kind).where(F.col("kind").isNotNull())


def group_sessions(files: DataFrame) -> DataFrame:
    """One row per (recording, tetrode) that has a spike file and a label file.

    The recording signature is the path without its suffix; label files carry
    ``_<tetrode>`` before theirs.
    """
    sig = lambda p: F.regexp_replace("path", p, "")
    tet = files.where("kind = 'tetrode'").select(
        sig(r"\.[0-9]+$").alias("signature"), F.regexp_extract("path", r"\.([0-9]+)$", 1).cast("int").alias("tetrode"), F.col("path").alias("tetrode_path"))
    def labels(kind, pattern, name):
        return files.where(F.col("kind") == kind).select(
            F.regexp_replace("path", pattern, "").alias("signature"),
            F.regexp_extract("path", pattern, 1).cast("int").alias("tetrode"), F.col("path").alias(name))
    cut = labels("cut", r"_([0-9]+)\.cut$", "cut_path")
    matched = labels("matched", r"_([0-9]+)_matched\.cut$", "matched_path")
    pos = files.where("kind = 'pos'").select(sig(r"\.pos$").alias("signature"), F.col("path").alias("pos_path"))
    key = ["signature", "tetrode"]
    return tet.join(cut, key).join(matched, key, "left").join(pos, "signature", "left")


def read_tracking(spark: SparkSession, path: str, ppm: float, jump: float = 2.0, settings: Settings = DEFAULT) -> DataFrame:
    """Tracking in centimetres: clock repair, centring, jump removal and boxcar smoothing of 0.4 s."""
    register(spark)
    raw = spark.read.format("recording_pos").load(path).withColumnRenamed("path", "session_id")
    rates = raw.groupBy("session_id").agg(F.first("sample_rate", True).alias("_rate"))
    # the clock steps at each file's own rate
    stepped = attach(raw.drop("sample_rate", "ppm"), rates.select("session_id", (1 / F.coalesce("_rate", F.lit(50.0))).alias("_step")), ["session_id"])
    t = strip_trailing_missing(repair_time(stepped, "_step", settings).drop("_step"))
    t = to_cm(t, ppm).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    t0 = t.groupBy("session_id").agg(F.min("t").alias("_t0"))
    t = attach(t, t0, ["session_id"]).withColumn("t", F.col("t") - F.col("_t0")).drop("_t0")
    # the width follows each file's own rate; a study has one or two of them
    widths = rates.select("session_id", F.ceil(F.coalesce("_rate", F.lit(50.0)) * 0.4).cast("int").alias("_width"))
    clean = attach(drop_jumps(t, jump, settings), widths, ["session_id"])
    found = sorted(r[0] for r in widths.select("_width").distinct().collect())
    parts = [boxcar(clean.where(F.col("_width") == w).drop("_width"), w, settings=settings) for w in found]
    if not parts:
        return clean.select("session_id", "i", "t", "x", "y")
    s = parts[0]
    for p in parts[1:]:
        s = s.unionByName(p)
    return s.select("session_id", "i", "t", F.col("x_smooth").alias("x"), F.col("y_smooth").alias("y"))


def read_spikes(spark: SparkSession, sessions: DataFrame, folder: str, use_matched: bool = False) -> DataFrame:
    """Spikes with their labels: an equi-join on (file, position in file)."""
    register(spark)
    spk = spark.read.format("recording_tetrode").load(folder).withColumnRenamed("path", "tetrode_path")
    lab = spark.read.format("recording_cut").load(folder)
    which = F.coalesce("matched_path", "cut_path") if use_matched else F.col("cut_path")
    link = sessions.select("signature", "tetrode", "tetrode_path", which.alias("_cut"))
    lab = attach(lab.withColumnRenamed("path", "_cut"), link, ["_cut"]).drop("_cut")
    return spk.join(lab, ["tetrode_path", "spike_idx"]).select("signature", "tetrode", "spike_idx", "t", "label", "channels", "samples")


def build_study(spark: SparkSession, folder: str, use_matched: bool = False, settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """files, sessions (numbered per animal, copies dropped) and spikes of the accepted cells."""
    register(spark)
    files = list_files(spark, folder)
    sessions = group_sessions(files)
    head = spark.read.format("recording_header").load(folder)
    when = head.where("key IN ('trial_date', 'trial_time')").groupBy("path").pivot("key", ["trial_date", "trial_time"]).agg(F.first("value"))
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.regexp_replace("trial_date", r"^\w+, ", ""), "trial_time"), F.lit("d MMM yyyy HH:mm:ss"))
    sessions = sessions.join(when.select(F.col("path").alias("tetrode_path"), stamp.alias("started_at")), "tetrode_path", "left")
    folder_name = F.regexp_extract("signature", r"([^/]+)/[^/]+$", 1)
    animal = F.concat(folder_name, F.lit("_tet"), F.col("tetrode").cast("string"))
    sessions = sessions.withColumn("animal_id", animal)
    spikes = read_spikes(spark, sessions, folder, use_matched)
    first = first_of_copies(spikes.withColumn("animal_id", animal), ["animal_id", "tetrode"], "signature", "t", ["t", "spike_idx"]).select("tetrode", "signature")
    sessions = sessions.join(first, ["tetrode", "signature"], "left_semi")
    sessions = Ordered(sessions, ["animal_id"], ["started_at", "signature"], settings).number("session_no").df
    kept = spikes.join(sessions.select("signature", "tetrode"), ["signature", "tetrode"], "left_semi")
    return {"files": files, "sessions": sessions, "spikes": valid_cells(kept, ["signature", "tetrode"])}


def microvolts(samples: DataFrame, gains: DataFrame, value: Column, wide: bool = False) -> DataFrame:
    """Scale raw samples by fullscale and channel gain: 1000 fullscale / (gain 128), or 32768 for the wide format."""
    base = 32_768.0 if wide else 128.0
    j = attach(samples, gains, ["path", "channel"])
    return j.withColumn("uv", value * safe_div(F.col("fullscale_mv") * 1000, F.col("gain") * F.lit(base)))
