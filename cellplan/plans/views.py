"""The test tables read as rasters: ``events`` is dense, so its ids are coordinates and its values intensities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import levels, raster

#: The same views for DuckDB.
PX = "px AS (SELECT event_id AS id, CAST(0 AS BIGINT) AS z, event_id // 100 AS y, event_id % 100 AS x, value AS v, event_type, user_id FROM events)"
PX3 = "px AS (SELECT event_id AS id, event_id // 2500 AS z, (event_id // 50) % 50 AS y, event_id % 50 AS x, value AS v, event_type FROM events)"
FG = "fg AS (SELECT * FROM px WHERE v > (SELECT quantile_cont(v, 0.6) FROM px))"
BLOCKS = "blk AS (SELECT *, (y // 5) * 20 + x // 5 + 1 AS label FROM fg)"
REF = "ref AS (SELECT *, (y // 7) * 20 + x // 7 + 1 AS ref_label FROM px WHERE event_type = 'purchase')"
N4 = "n4(dy, dx) AS (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))"
N8 = "n8(dy, dx) AS (SELECT a.d, b.d FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d))"
N6 = "n6(dz, dy, dx) AS (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))"


def labels_sql(source: str = "fg", offsets: str = "n4", out: str = "lab") -> str:
    """CTEs that label the components of a mask by their smallest id. Floods start where no neighbour has a smaller one."""
    return (
        f"e_{out} AS (SELECT p.id AS a, q.id AS b FROM {source} p CROSS JOIN {offsets} o JOIN {source} q ON q.y = p.y + o.dy AND q.x = p.x + o.dx WHERE p.id <> q.id), "
        f"r_{out}(root, node) AS (SELECT id, id FROM {source} WHERE id NOT IN (SELECT a FROM e_{out} WHERE b < a) UNION SELECT r.root, e.b FROM r_{out} r JOIN e_{out} e ON r.node = e.a WHERE r.root < e.b), "
        f"{out} AS (SELECT f.*, m.label FROM {source} f JOIN (SELECT node, min(root) AS label FROM r_{out} GROUP BY node) m ON f.id = m.node)"
    )


def otsu_sql(source: str) -> str:
    """CTEs that find Otsu's threshold (t.threshold) of the column u in 256 bins."""
    return f"""
b AS (SELECT min(u) lo, max(u) hi FROM {source}),
h AS (SELECT least(255, CAST(floor((u - lo) * 256 / (hi - lo)) AS INT)) AS bin, lo, hi, count(*) AS n FROM {source}, b GROUP BY ALL),
c AS (SELECT bin, n, lo + (bin + 0.5::DOUBLE) * (hi - lo) / 256 AS c FROM h),
w AS (SELECT bin, c, sum(n) OVER (ORDER BY bin) n0, sum(n * c) OVER (ORDER BY bin) s0, sum(n) OVER () n, sum(n * c) OVER () s FROM c),
v AS (SELECT bin, c, CASE WHEN n = n0 THEN 0 ELSE n0 * (n - n0) * pow(s0 / n0 - (s - s0) / (n - n0), 2) END AS v FROM w),
t AS (SELECT c AS threshold FROM v ORDER BY round(v, 6) DESC, bin LIMIT 1)"""


def ball_sql(name: str, radius: int) -> str:
    """A CTE of the offsets (dy, dx) of a disk."""
    return f"{name}(dy, dx) AS (SELECT a.d, b.d FROM range(-{radius}, {radius + 1}) a(d), range(-{radius}, {radius + 1}) b(d) WHERE a.d * a.d + b.d * b.d <= {radius * radius})"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf_dir).select(e.alias("id"), F.lit(0).cast("long").alias("z"), F.expr("event_id div 100").alias("y"), (e % 100).alias("x"), F.col("value").alias("v"), "event_type", "user_id")


def px3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf_dir).select(e.alias("id"), F.expr("event_id div 2500").alias("z"), F.expr("(event_id div 50) % 50").alias("y"), (e % 50).alias("x"), F.col("value").alias("v"), "event_type")


def fg(spark: SparkSession, sf_dir: str, three: bool = False) -> DataFrame:
    return levels.above((px3 if three else px)(spark, sf_dir), "v", 60)


def lab(spark: SparkSession, sf_dir: str, full: bool = False) -> DataFrame:
    return raster.components(fg(spark, sf_dir), full=full)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fg(spark, sf_dir).withColumn("label", F.expr("(y div 5) * 20 + x div 5 + 1"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).where("event_type = 'purchase'").withColumn("label", F.expr("(y div 7) * 20 + x div 7 + 1"))


def r6(*columns: str) -> list:
    """Columns rounded to six decimals, by their names."""
    return [F.round(F.col(c).cast("double"), 6).alias(c) for c in columns]
