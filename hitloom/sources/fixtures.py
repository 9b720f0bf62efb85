"""Inputs derived from the star-schema tables, as SQL that Spark and other engines read alike.

Each text names its tables in braces. spark_view() fills them with DataFrames, ctes()
with the names of the views, one common table expression each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Calibration, geometry and surface tables of the fixtures
SYSTEMS = {"SiTarget": 2, "SiPad": 1, "MTC": 3}

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


def _contributions(group: int) -> str:
    return f"""
SELECT event_idx, source_id, det, detector, layer, station, plane, strip, pad, seq, energy, time, pdg, particle_idx,
  CASE detector
    WHEN 'SiTarget' THEN 2 + layer * 256 + plane * 1048576 + strip * 33554432
    WHEN 'SiPad' THEN 1 + layer * 256 + strip * 1048576 + pad * 536870912
    ELSE 3 + station * 256 + layer * 1024 + plane * 4194304 + strip * 16777216 END AS cell_id,
  CASE detector WHEN 'SiTarget' THEN (strip - 25.5e0) * 0.8e0 WHEN 'SiPad' THEN strip * 5.5e0 ELSE (strip - 25.5e0) * 1.0e0 END AS hit_x,
  CASE WHEN detector = 'SiPad' THEN pad * 5.5e0 WHEN detector = 'SiTarget' AND plane = 1 THEN (strip - 25.5e0) * 0.8e0
    WHEN detector = 'SiTarget' THEN 0e0 ELSE (l_discount - 0.05e0) * 4000e0 END AS hit_y,
  CASE detector WHEN 'SiTarget' THEN -1000e0 + layer * 20e0 + plane * 2.35e0 WHEN 'SiPad' THEN -200e0 + layer * 20e0
    ELSE 2000e0 + station * 600e0 + layer * 20e0 + plane * 2.35e0 END AS hit_z
FROM (
  SELECT CAST(floor(l_orderkey / {group}e0) AS BIGINT) AS event_idx, CAST(1 + l_suppkey % 3 AS INT) AS source_id,
    CAST(least(l_partkey % 4, 2) AS INT) AS det, CASE l_partkey % 4 WHEN 0 THEN 'SiTarget' WHEN 1 THEN 'SiPad' ELSE 'MTC' END AS detector,
    CAST(floor(l_partkey / 4e0) AS BIGINT) % 5 AS layer, CAST(floor(l_suppkey / 3e0) AS BIGINT) % 3 AS station,
    CAST(CASE l_partkey % 4 WHEN 0 THEN l_linenumber % 2 WHEN 1 THEN 0 ELSE l_linenumber % 3 END AS BIGINT) AS plane,
    CAST(l_quantity AS BIGINT) AS strip, CAST(round(l_discount * 100) AS BIGINT) AS pad,
    row_number() OVER (PARTITION BY CAST(floor(l_orderkey / {group}e0) AS BIGINT) ORDER BY {_ORDER}) AS seq,
    l_extendedprice * 1e-9 AS energy, l_tax * 100e0 + l_quantity / 10e0 AS time,
    CASE l_returnflag WHEN 'A' THEN 13 WHEN 'N' THEN 211 ELSE -11 END AS pdg,
    CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS particle_idx, l_discount
  FROM {{lineitem}}) AS raw"""


SQL: dict[str, str] = {
    "contributions": _contributions(256),
    "overlay_contributions": _contributions(32),
    "mc_particles": f"""
SELECT event_idx, particle_idx, pdg, CASE WHEN particle_idx <= 2 THEN 1 ELSE 0 END AS generator_status,
  mass, px, py, pz, n_daughters
FROM (SELECT l_orderkey AS event_idx,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS particle_idx,
    CASE l_returnflag WHEN 'A' THEN 13 WHEN 'N' THEN 211 ELSE -11 END AS pdg,
    CASE l_returnflag WHEN 'A' THEN 0.10566e0 WHEN 'N' THEN 0.13957e0 ELSE 0.000511e0 END AS mass,
    (l_discount - 0.05e0) * 2e0 AS px, (l_tax - 0.04e0) * 2e0 AS py, l_extendedprice / 10000e0 AS pz,
    CASE WHEN l_linestatus = 'F' THEN 0 ELSE 2 END AS n_daughters FROM {{lineitem}}) AS p""",
    "stream": """
SELECT CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS INT) AS source_id,
  user_id AS cell_id, event_id AS seq, ts, value AS energy
FROM {events}""",
    "segments": """
SELECT CAST(floor(o_orderkey / 16e0) AS BIGINT) AS window_id, o_orderkey AS segment_id, CAST(o_custkey % 3 AS INT) AS det,
  o_totalprice / 20000e0 AS chi2, CAST(1 + o_custkey % 12 AS INT) AS ndf,
  (o_custkey % 11 - 5) * 6e0 AS y, (o_orderkey * 7 % 13 - 6) * 4e0 AS z,
  (o_custkey % 7 - 3) * 0.01e0 AS ty, (o_orderkey % 5 - 2) * 0.01e0 AS tz
FROM {orders}""",
    # planes that hits lie on, along the beam
    "surfaces": f"""SELECT DISTINCT det, hit_z AS x FROM ({_contributions(256)}) AS c""",
    # places and directions of both ends of the segments; some run across the beam
    "segment_ends": """
SELECT window_id, segment_id, det, f_x, f_y, f_z, b_x, f_y + (b_x - f_x) * ty AS b_y, f_z + (b_x - f_x) * tz AS b_z,
  across AS f_dx, ty / sqrt(1 + ty * ty + tz * tz) AS f_dy, tz / sqrt(1 + ty * ty + tz * tz) AS f_dz,
  1 / sqrt(1 + (ty + kink) * (ty + kink) + tz * tz) AS b_dx, (ty + kink) / sqrt(1 + (ty + kink) * (ty + kink) + tz * tz) AS b_dy, tz / sqrt(1 + (ty + kink) * (ty + kink) + tz * tz) AS b_dz
FROM (SELECT *, f_x + 20e0 * (1 + segment_id % 2) AS b_x, CASE WHEN segment_id % 29 = 0 THEN 1e-9 ELSE 1 / sqrt(1 + ty * ty + tz * tz) END AS across FROM (
  SELECT CAST(floor(o_orderkey / 16e0) AS BIGINT) AS window_id, o_orderkey AS segment_id, CAST(o_custkey % 3 AS INT) AS det,
    CASE o_custkey % 3 WHEN 0 THEN -1000e0 WHEN 1 THEN -200e0 ELSE 2000e0 END + (o_orderkey % 3) * 20e0 AS f_x,
    (o_custkey % 11 - 5) * 6e0 AS f_y, (o_orderkey * 7 % 13 - 6) * 4e0 AS f_z, (o_custkey % 7 - 3) * 0.01e0 AS ty, (o_orderkey % 5 - 2) * 0.01e0 AS tz,
    (o_custkey % 4) * 0.002e0 AS kink
  FROM {orders}) AS e0) AS e1""",
    "segment_hits": """
SELECT DISTINCT CAST(floor(l_orderkey / 16e0) AS BIGINT) AS window_id, l_orderkey AS segment_id, l_partkey % 6 AS hit_id FROM {lineitem}""",
    "track_states": f"""
SELECT CAST(floor(l_orderkey / 16e0) AS BIGINT) AS window_id, l_orderkey % 16 AS track_id, l_quantity * 3e0 AS z,
  CASE l_linenumber % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 0.0871557e0 ELSE -0.0871557e0 END AS tilt,
  (l_discount - 0.05e0) * 1000e0 AS x, (l_tax - 0.04e0) * 1000e0 AS y, (l_partkey % 100 - 50) / 10e0 AS loc0, l_tax * 50e0 AS chi2,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, {_ORDER}) AS seq FROM {{lineitem}}""",
    "trials": """
SELECT experiment, trial_id, o_orderkey AS order_id, status, nhits_sipad, cost_proxy, wall_time_s, w_thickness, n_layers, submitted_at,
  CASE WHEN status = 'COMPLETED' AND n_done = 1 THEN 'baseline' WHEN trial_id < 8 THEN 'sobol' ELSE 'qlognehvi' END AS tag
FROM (SELECT *, sum(CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END) OVER (PARTITION BY experiment ORDER BY trial_id ROWS UNBOUNDED PRECEDING) AS n_done
  FROM (SELECT o_custkey % 40 AS experiment, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS trial_id, o_orderkey,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE 'SUBMITTED' END AS status,
    o_totalprice AS nhits_sipad, (o_orderkey * 7919 % 10007) / 10e0 AS cost_proxy, 60 + o_custkey % 540 AS wall_time_s,
    10 + o_custkey % 21 AS w_thickness, 10 + o_orderkey % 11 AS n_layers, o_orderdate AS submitted_at
  FROM {orders}) AS t0) AS t1""",
    "samples": """
SELECT o_orderkey, CAST(floor(o_orderkey / 16e0) AS BIGINT) AS window_id,
  concat('tracks_', CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'mu_pi' ELSE 'e_pi' END, '_angle_',
    CASE o_custkey % 4 WHEN 0 THEN '1.0' WHEN 1 THEN '2.0' WHEN 2 THEN '5.0' ELSE '10.0' END, '.edm4hep.root') AS file_name
FROM {orders}""",
}

TABLES = ("lineitem", "orders", "events")


#: rows of a table that a task sorts or groups at once, as far as keys allow
ROWS_OF_A_TASK = 250_000

#: what the rows of a text's table are numbered by
NUMBERED_BY = {"contributions": "CAST(floor(l_orderkey / 256e0) AS BIGINT)", "overlay_contributions": "CAST(floor(l_orderkey / 32e0) AS BIGINT)", "mc_particles": "l_orderkey", "track_states": "l_orderkey"}


def parts_of(spark: SparkSession, sf_dir: str, table: str) -> int | None:
    """How many partitions keep a table's tasks small, by the counts in its files; None where the session's own number does."""
    n = -(-spark.read.parquet(f"{sf_dir}/{table}.parquet").count() // ROWS_OF_A_TASK)
    return n if n > spark.sparkContext.defaultParallelism else None


def spark_view(spark: SparkSession, sf_dir: str, name: str, numbered: bool = True) -> DataFrame:
    """A text over the tables; where its row numbers are not read (numbered=False), nothing is dealt for them."""
    text = SQL[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    if numbered and name in NUMBERED_BY and (n := parts_of(spark, sf_dir, "lineitem")):
        used["lineitem"] = used["lineitem"].repartition(n, F.expr(NUMBERED_BY[name]))
    return spark.sql(text, **used)


def ctes(*names: str, **more: str) -> str:
    """WITH name AS (...), ... of fixtures and of further texts, in this order."""
    parts = [f"{n} AS ({SQL[n].format(**{t: t for t in TABLES})})" for n in names] + [f"{n} AS ({t})" for n, t in more.items()]
    return "WITH " + ", ".join(parts) + " "
