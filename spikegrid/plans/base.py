"""Recording tables derived from the given tables, and the query registry.

events       -> tracking samples (view, signup, error) and spikes (click, purchase);
                session = user, position = (value, props.k)
embeddings   -> spike waveforms: 4 channels x 16 samples, cluster = label
orders ...   -> session reports

Every registered query reads whole tables.  Its SQL text is composed from the
named common table expressions below and runs on any ANSI engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spikegrid.functions.expr import Extent
from spikegrid.operators.ordered import ChunkPlan, plan_chunks
from spikegrid.session import tune, widen_shuffles
from spikegrid.settings import DEFAULT, Settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# fixed values of the driver mapping
TRACK_TYPES = ("view", "signup", "error")
SPIKE_TYPES = ("click", "purchase")
ORIGIN = "2024-01-01"
ROWS = COLS = 16
ARENA = Extent(0.0, 300.0, 0.0, 100.0)
SPEED_HIGH = 0.05
OPTIONS: Settings = DEFAULT.but(rows=ROWS, cols=COLS, smoothing_factor=1.0, speed_high=SPEED_HIGH)


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL text that must give the same rows."""

    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


def rd(c, digits: int = 4) -> Column:
    """Rounded value without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def R(expr: str, digits: int = 4) -> str:
    return f"(ROUND({expr}, {digits}) + 0)"


# ------------------------------------------------------------------- tables
_ROWS: dict[tuple, int] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; shuffles are sized by its rows (counted once, from the files' footers)."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    memo = (spark.sparkContext.applicationId, sf, name)
    if memo not in _ROWS:
        _ROWS[memo] = df.count()
    widen_shuffles(spark, _ROWS[memo])
    return df


def events(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    origin = F.unix_micros(F.to_timestamp(F.lit(ORIGIN)))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("i"),
        F.col("event_type").alias("unit"),
        ((ts - origin) / F.lit(1e6)).alias("t"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
    )


_PLANS: dict[tuple, ChunkPlan] = {}


def options(spark: SparkSession, sf: str, key: str = "session_id", fan_out: int = 1) -> Settings:
    """The options with the chunk plan of the events table (one count per table and session).

    ``fan_out`` is the factor by which a query multiplies the rows of a key.
    """
    s = OPTIONS.but(rows_per_chunk=max(1, OPTIONS.rows_per_chunk // fan_out))
    memo = (spark.sparkContext.applicationId, sf, s.rows_per_chunk)
    if memo not in _PLANS:
        _PLANS[memo] = plan_chunks(events(spark, sf).select("session_id", "t"), ["session_id"], "t", s)
    plan = _PLANS[memo]
    return s.but(chunks=plan if key == "session_id" else plan.renamed(session_id=key))


def tracking(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where(F.col("unit").isin(*TRACK_TYPES)).drop("unit")


def spikes(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where(F.col("unit").isin(*SPIKE_TYPES)).select("session_id", "unit", "i", "t")


def all_units(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a spike of the unit named by its type."""
    return events(spark, sf).select("session_id", "unit", "i", "t")


# ---------------------------------------------------------------- SQL pieces
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], text: str) -> None:
    _PARTS[name] = (needs, text)


def compose(body: str, *needs: str) -> str:
    """``WITH`` clause of the named pieces (dependencies first) plus the body."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in _PARTS[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n][1]})" for n in order) + "\n" + body


_types = lambda names: ", ".join(f"'{n}'" for n in names)

part("ev", (), f"""
  SELECT user_id AS session_id, event_id AS i, event_type AS unit,
         (epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}')) / 1e6 AS t, value AS x,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events""")
part("trk", ("ev",), f"SELECT session_id, i, t, x, y FROM ev WHERE unit IN ({_types(TRACK_TYPES)})")
part("spk", ("ev",), f"SELECT session_id, unit, i, t FROM ev WHERE unit IN ({_types(SPIKE_TYPES)})")
part("speed", ("trk",), """
  SELECT session_id, i, t, x, y,
    CASE WHEN p1 IS NULL AND n2 IS NOT NULL THEN sqrt((nx2-x)*(nx2-x)+(ny2-y)*(ny2-y))/(n2-t)
         WHEN p1 IS NULL THEN 0.0
         WHEN n1 IS NULL AND p2 IS NOT NULL THEN sqrt((x-px2)*(x-px2)+(y-py2)*(y-py2))/(t-p2)
         WHEN n1 IS NULL THEN 0.0
         ELSE sqrt((nx1-px1)*(nx1-px1)+(ny1-py1)*(ny1-py1))/(n1-p1) END AS speed
  FROM (SELECT *, lag(t) OVER w p1, lag(t,2) OVER w p2, lead(t) OVER w n1, lead(t,2) OVER w n2,
          lag(x) OVER w px1, lag(x,2) OVER w px2, lead(x) OVER w nx1, lead(x,2) OVER w nx2,
          lag(y) OVER w py1, lag(y,2) OVER w py2, lead(y) OVER w ny1, lead(y,2) OVER w ny2
        FROM trk WINDOW w AS (PARTITION BY session_id ORDER BY t, i))""")
part("moving", ("speed",), f"SELECT * FROM speed WHERE speed > 0 AND speed < {SPEED_HIGH}")
part("pos", ("spk", "moving"), """
  SELECT session_id, unit, i, t, x, y FROM (
    SELECT s.session_id, s.unit, s.i, s.t, m.x, m.y,
           row_number() OVER (PARTITION BY s.session_id, s.i ORDER BY abs(m.t - s.t), m.t, m.i) rn
    FROM spk s JOIN moving m ON s.session_id = m.session_id) WHERE rn = 1""")
part("step", ("trk",), "SELECT *, t - lag(t) OVER (PARTITION BY session_id ORDER BY t, i) AS dt FROM trk")


def node(value: str, lo: float, hi: float, n: int) -> str:
    step = (hi - lo) / (n - 1)
    return f"CAST(greatest(0, least({n - 1}, ceil(({value} - {lo!r}) / {step!r}::DOUBLE - 0.5))) AS INTEGER)"


ROW_SQL = node(f"({ARENA.y_hi!r} - y)", 0.0, ARENA.y_hi - ARENA.y_lo, ROWS)
COL_SQL = node("x", ARENA.x_lo, ARENA.x_hi, COLS)
part("occ", ("step",), f"""
  SELECT session_id, {ROW_SQL} AS r, {COL_SQL} AS c, sum(dt) AS v
  FROM step WHERE dt IS NOT NULL GROUP BY 1, 2, 3""")
part("spkmap", ("pos",), f"""
  SELECT session_id, unit, {ROW_SQL} AS r, {COL_SQL} AS c, CAST(count(*) AS DOUBLE) AS v
  FROM pos GROUP BY 1, 2, 3, 4""")
part("rate", ("occ", "spkmap"), """
  SELECT s.session_id, s.unit, s.r, s.c, s.v / o.v AS v FROM spkmap s
  JOIN occ o ON s.session_id = o.session_id AND s.r = o.r AND s.c = o.c WHERE o.v >= 1e-4""")
part("grid", (), f"""
  SELECT CAST(a.r AS INTEGER) AS r, CAST(b.c AS INTEGER) AS c
  FROM range({ROWS}) AS a(r), range({COLS}) AS b(c)""")
part("units", ("rate",), "SELECT DISTINCT session_id, unit FROM rate")
part("dense", ("units", "grid", "rate"), """
  SELECT u.session_id, u.unit, g.r, g.c, coalesce(m.v, 0.0) AS v FROM units u CROSS JOIN grid g
  LEFT JOIN rate m ON m.session_id = u.session_id AND m.unit = u.unit AND m.r = g.r AND m.c = g.c""")
