"""Queries of seed extraction and trimming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels, levels, raster, seeds, trim
from ..operators.raster import AXES
from .views import BLOCKS, FG, N4, PX, ball_sql, blocks, fg, lab, labels_sql, otsu_sql, px, r6

DISTANCES = f"{PX}, {FG}, {BLOCKS}, bgd AS (SELECT y AS by_, x AS bx_ FROM px WHERE id NOT IN (SELECT id FROM fg)), dt AS (SELECT id, label, sqrt(min((y - by_) * (y - by_) + (x - bx_) * (x - bx_))::DOUBLE) AS d FROM blk, bgd GROUP BY 1, 2)"


def _distances(s, d):
    """Foreground pixels of the blocks with their distance to the background."""
    p = px(s, d)
    return raster.distance_transform(p, p.join(fg(s, d).select("id"), "id", "left_anti")).join(blocks(s, d).select("id", *AXES, "label"), list(AXES))


def _sizes(s, d):
    return seeds.size_statistics(lab(s, d), 25, 75, 5).select(*r6("low", "high"))


def _references(s, d):
    return seeds.reference_labels(lab(s, d), 30, 70, most=30)


def _thickness(s, d):
    thick = _distances(s, d).groupBy("label").agg(F.max("distance").alias("t"))
    return thick.agg(F.round(seeds.least_thickness(F.col("t"), 60, 1.5, 10.0), 6).alias("least"))


def _strategies(s, d):
    sizes = s.read.parquet(f"{d}/part.parquet").select((F.col("p_size") * 2).alias("p")).distinct()
    return sizes.select("p", F.round(2 + F.col("p") / 1000, 6).alias("intensity_score"), F.round(F.col("p") / 100 + F.col("p") / 100_000, 6).alias("distance_score"))


def _candidates(s, d):
    cells = raster.size_filter(lab(s, d), 8)
    found = seeds.extract_seeds(cells, "v", least_fragment=2, separation_um=0.0, least_thickness=0.5, ratios=(0.5,), percentiles=(80, 50))
    return found.groupBy("label").agg(F.count_distinct("seed").alias("seeds"), F.count("*").alias("voxels"))


def _hull(s, d):
    return trim.hull(px(s, d), fg(s, d), "v", 2, 2, 4)


def _grown(source: str, offsets: str) -> str:
    return f"SELECT DISTINCT y + dy AS y, x + dx AS x FROM {source}, {offsets}"


def hull_sql(cells: str, factor: int, least: int) -> str:
    """CTEs of the tissue's mask (hull) as trim.hull() finds it in 2D with a closing radius of 2, for the mask ``cells``."""
    coarse = f"SELECT DISTINCT y // {factor} AS y, x // {factor} AS x, (y // {factor}) * 1000 + x // {factor} AS id FROM {{}} WHERE y % {factor} = 0 AND x % {factor} = 0"
    return f"""q AS (SELECT ln(1 + v) AS u FROM px WHERE v > 0), {otsu_sql('q')}, {ball_sql('b2', 2)}, {ball_sql('b3', 3)},
bright AS (SELECT y, x FROM px, t WHERE v > exp(threshold * 0.8::DOUBLE) - 1 UNION SELECT y, x FROM {cells}), crs AS ({coarse.format('bright')}), dom AS ({coarse.format('px')}), {labels_sql('crs', 'n4', 'lc')},
kept AS (SELECT y, x FROM lc QUALIFY count(*) OVER (PARTITION BY label) >= {least}), g3 AS ({_grown('kept', 'b3')}), g2 AS ({_grown('g3', 'b2')}),
cls AS (SELECT d.* FROM dom d JOIN (SELECT y + dy AS y, x + dx AS x FROM g2, b2 GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM b2)) USING (y, x)), {labels_sql('cls', 'n4', 'lb')},
part AS (SELECT id, y, x FROM lb WHERE label = (SELECT label FROM lb GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)), emp AS (SELECT * FROM dom ANTI JOIN part USING (id)), {labels_sql('emp', 'n4', 'le')},
rim AS (SELECT DISTINCT label FROM le, (SELECT min(y) a, max(y) b, min(x) c, max(x) d FROM dom) WHERE y IN (a, b) OR x IN (c, d)),
whole AS (SELECT y, x FROM part UNION SELECT y, x FROM le ANTI JOIN rim USING (label)),
hull AS (SELECT p.y, p.x FROM px p JOIN (SELECT y * {factor} + i AS y, x * {factor} + j AS x FROM whole, range({factor}) r(i), range({factor}) s(j)) USING (y, x))"""


HULL = f"WITH RECURSIVE {PX}, {FG}, {N4}, {hull_sql('fg', 2, 4)} SELECT y, x FROM hull"
BOUNDARY = f"WITH RECURSIVE {PX}, {FG}, {N4}, {hull_sql('fg', 2, 4)} SELECT y, x FROM hull WHERE (y, x) NOT IN (SELECT (y + dy, x + dx) FROM hull, n4 GROUP BY y + dy, x + dx HAVING count(*) = 5)"
#: The threshold of 3 is above 2, so the brightness cutoff is 1.5 times itself; the core grows 6 steps, edges reach 1.5 pixels.
TRIM = f"""WITH RECURSIVE {PX}, {FG}, {N4}, near(dy, dx) AS (SELECT a.d, b.d FROM range(-1, 2) a(d), range(-1, 2) b(d)), core(dy, dx) AS (SELECT a.d, b.d FROM range(-6, 7) a(d), range(-6, 7) b(d) WHERE abs(a.d) + abs(b.d) <= 6),
{labels_sql('fg', 'n4', 'lab')}, zero AS (SELECT y, x FROM px WHERE v < 1e-4), cut AS (SELECT id, y, x, label FROM lab ANTI JOIN ({_grown('zero', 'near')}) USING (y, x)), {hull_sql('cut', 4, 100)},
outside AS (SELECT y, x FROM px ANTI JOIN hull USING (y, x)), shine AS (SELECT y, x FROM px WHERE v > 4.5), doomed AS (SELECT y, x FROM ({_grown('outside', 'near')}) ANTI JOIN ({_grown('shine', 'core')}) USING (y, x))
SELECT label, count(*) AS n FROM cut ANTI JOIN doomed USING (y, x) GROUP BY label HAVING count(*) >= 3"""


def _boundary(s, d):
    return trim.boundary(_hull(s, d)).select("y", "x")


def _trim(s, d):
    kept, _ = trim.trim(lab(s, d).select(*AXES, "label"), px(s, d), 3.0, 1.5, 1.5, 3, value="v", closing_radius=2)
    return kept.groupBy("label").agg(F.count("*").alias("n"))


def _branches(s, d):
    skel = kernels.skeletonize(raster.size_filter(lab(s, d, True), 10))
    return skel.groupBy("label").agg(F.max("n_paths").alias("paths"), F.round(F.max("total_length"), 6).alias("total_length"), F.count("*").alias("voxels"))


def _peaks(s, d):
    """Pixels of the distance map that no neighbour in the box exceeds: a maximum over the exploded neighbourhood."""
    dist = _distances(s, d).select(*AXES, "distance")
    top = raster.shifted(dist, raster.box()).groupBy(*AXES).agg(F.max("distance").alias("m"))
    return dist.join(top, list(AXES)).where("distance >= m").select("y", "x", *r6("distance"))


PEAKS = f"WITH {DISTANCES}, c AS (SELECT id, id // 100 AS y, id % 100 AS x, d FROM dt) SELECT a.y, a.x, round(a.d, 6) AS distance FROM c a JOIN c b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.y, a.x, a.d HAVING a.d >= max(b.d)"
_REGISTERED = {
    "population_sizes": (
        _sizes,
        f"WITH RECURSIVE {PX}, {FG}, {N4}, {labels_sql()}, s AS (SELECT label, count(*) AS n FROM lab GROUP BY 1), e AS (SELECT n FROM s QUALIFY row_number() OVER (ORDER BY label) % 5 = 1) SELECT round(quantile_cont(n::DOUBLE, 0.25), 6) AS low, round(quantile_cont(n::DOUBLE, 0.75), 6) AS high FROM e",
    ),
    "reference_objects": (
        _references,
        f"WITH RECURSIVE {PX}, {FG}, {N4}, {labels_sql()}, s AS (SELECT label, count(*) AS n FROM lab GROUP BY 1), q AS (SELECT quantile_cont(n::DOUBLE, 0.3) AS a, quantile_cont(n::DOUBLE, 0.7) AS b FROM s), t AS (SELECT label FROM s, q WHERE n > a AND n <= b ORDER BY label LIMIT 30), f AS (SELECT label FROM s ORDER BY label LIMIT 30) SELECT label FROM t WHERE (SELECT count(*) FROM t) >= 5 UNION ALL SELECT label FROM f WHERE (SELECT count(*) FROM t) < 5",
    ),
    "least_thickness": (_thickness, f"WITH {DISTANCES}, t AS (SELECT label, max(d) AS t FROM dt GROUP BY 1) SELECT round(least(greatest(1.5::DOUBLE, quantile_cont(t, 0.6)), 9.9::DOUBLE), 6) AS least FROM t"),
    "seed_strategies": (_strategies, "WITH p AS (SELECT DISTINCT p_size * 2 AS p FROM part) SELECT p, round(2 + p / 1000.0::DOUBLE, 6) AS intensity_score, round(p / 100.0::DOUBLE + p / 100000.0::DOUBLE, 6) AS distance_score FROM p"),
    "distance_core": (lambda s, d: seeds.distance_core(_distances(s, d), 0.6).select("id", "label"), f"WITH {DISTANCES} SELECT id, label FROM dt QUALIFY d >= 0.6::DOUBLE * max(d) OVER (PARTITION BY label)"),
    "intensity_core": (
        lambda s, d: seeds.intensity_core(blocks(s, d), 70, "v").select("id", "label"),
        f"WITH {PX}, {FG}, {BLOCKS}, q AS (SELECT label, quantile_cont(v, 0.7) AS q FROM blk GROUP BY 1) SELECT id, label FROM blk JOIN q USING (label) WHERE v >= q",
    ),
    "core_aspect_ratio": (
        lambda s, d: seeds.aspect_ratio(blocks(s, d)).select("label", "n", F.round("aspect", 4).alias("aspect")),
        f"WITH {PX}, {FG}, {BLOCKS}, m AS (SELECT label, var_samp(y) AS a, var_samp(x) AS b, covar_samp(y, x) AS c, count(*) AS n FROM blk GROUP BY 1), r AS (SELECT label, n, (a + b) / 2 AS h, sqrt(pow((a - b) / 2, 2) + c * c) AS q FROM m) SELECT label, n, CASE WHEN n > 2 AND h - q > 1e-9 THEN round(sqrt((h + q) / (h - q)), 4) END AS aspect FROM r",
    ),
    "distance_peaks": (_peaks, PEAKS),
    "seed_candidates": (_candidates, None),
    "hull_mask": (lambda s, d: _hull(s, d).select("y", "x"), HULL),
    "hull_boundary": (_boundary, BOUNDARY),
    "trim_orchestration": (_trim, TRIM),
    "skeleton_branches": (_branches, None),
    "minimum_threshold_guard": (
        lambda s, d: levels.foreground_threshold(px(s, d).where("event_type = 'none'"), "v", 60).select("threshold", "samples"),
        "SELECT 1e9::DOUBLE AS threshold, count(*) AS samples FROM events WHERE event_type = 'none'",
    ),
}
QUERIES = {k: q for k, (q, _) in _REGISTERED.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in _REGISTERED.items() if sql}
