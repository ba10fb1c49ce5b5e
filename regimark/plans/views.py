"""Stand-ins for frame tables: events as frames of one video a user, embeddings as images of 8 x 8 pixels.

Each view has its SQL beside it, for the counterparts of queries over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import first_argmax, rounded, softmax
from ..operators.frames import positional
from ..operators.temporal import INITIAL, TRANSITION

CENTRES = (0.1, 0.5, 1.2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame_index, intensity, power, active; p_low, p_nominal, p_high and the largest one's label."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("power"))
    f = positional(e, ["ts", "event_id"], "user_id").select(F.col("user_id").alias("video_id"), F.col("frame_index").cast("long").alias("frame_index"), F.col("value").alias("intensity"), F.col("power").cast("double").alias("power"), (F.col("value") >= 5).cast("int").alias("active"))
    z = F.col("intensity") / 100.0
    p = softmax([-8.0 * (z - c) * (z - c) for c in CENTRES])
    f = f.withColumns(dict(zip(("p_low", "p_nominal", "p_high"), [rounded(x) for x in p], strict=True)))
    return f.withColumn("label", first_argmax([F.col("p_low"), F.col("p_nominal"), F.col("p_high")]).cast("long"))


FRAMES = f"""base AS (
  SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, value AS intensity,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS power, CAST(value >= 5 AS INTEGER) AS active, value / 100.0 AS z FROM events),
logits AS (SELECT *, {", ".join(f"-8.0 * (z - {c}) * (z - {c}) AS l{k}" for k, c in enumerate(CENTRES))} FROM base),
powers AS (SELECT *, {", ".join(f"exp(l{k} - greatest(l0, l1, l2)) AS e{k}" for k in range(3))} FROM logits),
probs AS (SELECT *, round(e0 / (e0 + e1 + e2), 6) AS p_low, round(e1 / (e0 + e1 + e2), 6) AS p_nominal, round(e2 / (e0 + e1 + e2), 6) AS p_high FROM powers),
frames AS (SELECT video_id, frame_index, intensity, power, active, p_low, p_nominal, p_high,
  CAST(CASE WHEN p_low >= p_nominal AND p_low >= p_high THEN 0 WHEN p_nominal >= p_high THEN 1 ELSE 2 END AS BIGINT) AS label FROM probs)"""

SEGMENTS = """act AS (SELECT * FROM frames WHERE active = 1),
gaps AS (SELECT *, CASE WHEN frame_index - lag(frame_index) OVER (PARTITION BY video_id ORDER BY frame_index) > 1 THEN 1 ELSE 0 END AS gap FROM act),
seg AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY video_id ORDER BY frame_index) AS BIGINT) AS segment FROM gaps)"""


def _viterbi_sql() -> str:
    t = lambda k, j: f"f.d{k} + ln({TRANSITION[k][j]})"
    emit = ["p_low", "p_nominal", "p_high"]
    start = ", ".join(f"ln({INITIAL[j]}) + ln(greatest({emit[j]}, 1e-12)) AS d{j}" for j in range(3))
    best = ", ".join(f"greatest({t(0, j)}, {t(1, j)}, {t(2, j)}) + ln(greatest(s.{emit[j]}, 1e-12))" for j in range(3))
    back = ", ".join(f"CASE WHEN {t(0, j)} >= {t(1, j)} AND {t(0, j)} >= {t(2, j)} THEN 0 WHEN {t(1, j)} >= {t(2, j)} THEN 1 ELSE 2 END" for j in range(3))
    return f"""pos AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment ORDER BY frame_index) AS pos, count(*) OVER (PARTITION BY video_id, segment) AS n FROM seg),
fwd AS (
  SELECT video_id, segment, pos, n, frame_index, {start}, -1 AS b0, -1 AS b1, -1 AS b2 FROM pos WHERE pos = 1
  UNION ALL
  SELECT s.video_id, s.segment, s.pos, s.n, s.frame_index, {best}, {back}
  FROM fwd f JOIN pos s ON s.video_id = f.video_id AND s.segment = f.segment AND s.pos = f.pos + 1),
bwd AS (
  SELECT video_id, segment, pos, frame_index, b0, b1, b2, CASE WHEN d0 >= d1 AND d0 >= d2 THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS temporal_label FROM fwd WHERE pos = n
  UNION ALL
  SELECT f.video_id, f.segment, f.pos, f.frame_index, f.b0, f.b1, f.b2, CASE b.temporal_label WHEN 0 THEN b.b0 WHEN 1 THEN b.b1 ELSE b.b2 END
  FROM bwd b JOIN fwd f ON f.video_id = b.video_id AND f.segment = b.segment AND f.pos = b.pos - 1),
decoded AS (SELECT video_id, frame_index, segment, CAST(temporal_label AS BIGINT) AS temporal_label FROM bwd)"""


VITERBI = _viterbi_sql()


def with_frames(sql: str) -> str:
    return f"WITH {FRAMES} {sql}"


def with_segments(sql: str) -> str:
    return f"WITH {FRAMES}, {SEGMENTS} {sql}"


def with_decoded(sql: str) -> str:
    return f"WITH RECURSIVE {FRAMES}, {SEGMENTS}, {VITERBI} {sql}"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, x, y, level of each vector as an image."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("at", "v"))
    level = F.least(F.lit(255), F.floor(F.abs(F.col("v").cast("double")) * 255).cast("int"))
    return e.select("frame_id", (F.col("at") % 8).alias("x"), F.floor(F.col("at") / 8).cast("int").alias("y"), level.alias("level"))


PIXELS = """flat AS (SELECT vec_id AS frame_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS place FROM embeddings),
pixels AS (SELECT frame_id, CAST(place % 8 AS INTEGER) AS x, CAST(place // 8 AS INTEGER) AS y, least(255, CAST(floor(abs(CAST(v AS DOUBLE)) * 255) AS INTEGER)) AS level FROM flat)"""
