"""Queries of raster operators: thresholds, morphology, components, distances, set operations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import kernels, levels, measure, raster
from ..operators.raster import AXES
from .views import FG, N4, N8, PX, PX3, blocks, fg, lab, labels_sql, otsu_sql, px, px3, r6, reference

OUT = ["y", "x"]


def segment_and_measure(spark, sf_dir):
    """The flagship: threshold, label, drop small objects, measure them; the 20 largest."""
    t = measure.summary(lab(spark, sf_dir), "v", dims=2, least=5)
    return t.orderBy(F.desc("pixel_count"), "label").limit(20).select("label", "pixel_count", *r6("area_um2", "mean_intensity", "median_intensity", "std_intensity", "integrated_density", "max_intensity"), "y_min", "y_max", "x_min", "x_max")


def _mask(f):
    return lambda s, d: f(fg(s, d)).select(*OUT)


def _dilate_sql(offsets: str) -> str:
    return f"WITH {PX}, {FG}, o(dy, dx) AS ({offsets}) SELECT DISTINCT y + dy AS y, x + dx AS x FROM fg, o"


def _ball_sql(radius: float) -> str:
    r = math.floor(radius)
    return f"SELECT a.d, b.d FROM range(-{r}, {r + 1}) a(d), range(-{r}, {r + 1}) b(d) WHERE a.d * a.d + b.d * b.d <= {radius * radius}"


def _components(full):
    return lambda s, d: raster.components(fg(s, d), full=full).select("id", "label")


def _z_erosion(s, d):
    return raster.clamped_z_erosion(fg(s, d, True), 1).select("z", "y", "x")


def _holes(s, d):
    whole = px(s, d)
    return raster.hole_voxels(levels.above(whole, "v", 40), whole).select("id")


def _trim_zero(s, d):
    p = px(s, d)
    return raster.zero_edge_trim(fg(s, d), p, 2.0, floor=1.0, value="v").select("id")


def _trim_edge(s, d):
    p = px(s, d)
    return raster.edge_trim(fg(s, d), reference(s, d), levels.above(p, "v", 95), 2.0, 2).select("id")


def _edt(s, d):
    return raster.distance_transform(px(s, d), reference(s, d)).select("y", "x", *r6("distance"))


def _edt_nearest(s, d):
    """The distance to the reference pixel that the transform names, of each pixel."""
    near = raster.distance_transform(px(s, d), reference(s, d), nearest="id")
    at = reference(s, d).select("id", F.col("y").alias("ry"), F.col("x").alias("rx"))
    return near.join(at, "id").select("y", "x", F.round(F.sqrt(((F.col("y") - F.col("ry")) ** 2 + (F.col("x") - F.col("rx")) ** 2).cast("double")), 6).alias("distance"))


def _otsu(s, d):
    return levels.otsu(px(s, d), "v").select(*r6("threshold"))


def _log_hull(s, d):
    return levels.log_otsu_hull_level(px(s, d), "v").select(*r6("threshold"))


def _gauss(s, d):
    return kernels.gaussian_smooth(px(s, d), "v", 1.0, tile=64).select("y", "x", *r6("smooth"))


def _gauss_sql() -> str:
    taps = levels.gaussian_taps(1.0)
    r = len(taps) // 2
    t = ", ".join(f"({k - r}, {v!r}::DOUBLE)" for k, v in enumerate(taps))
    # Beyond the border the raster is mirrored, the edge voxel included.
    return f"""WITH {PX}, t(d, w) AS (VALUES {t}), s AS (SELECT max(y) + 1 AS ny, max(x) + 1 AS nx FROM px),
a AS (SELECT p.y, p.x, sum(q.v * t.w) AS v FROM px p, s, t, px q WHERE q.y = p.y AND q.x = CASE WHEN p.x + d < 0 THEN -(p.x + d) - 1 WHEN p.x + d >= nx THEN 2 * nx - 1 - (p.x + d) ELSE p.x + d END GROUP BY 1, 2)
SELECT p.y, p.x, round(sum(q.v * t.w), 6) AS smooth FROM a p, s, t, a q WHERE q.x = p.x AND q.y = CASE WHEN p.y + d < 0 THEN -(p.y + d) - 1 WHEN p.y + d >= ny THEN 2 * ny - 1 - (p.y + d) ELSE p.y + d END GROUP BY 1, 2"""


def _tophat_sql() -> str:
    return f"""WITH {PX}, o AS (SELECT a.d AS dy, b.d AS dx FROM range(-2, 3) a(d), range(-2, 3) b(d)),
m AS (SELECT p.y, p.x, min(q.v) AS v FROM px p, o JOIN px q ON q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY 1, 2),
k AS (SELECT p.y, p.x, max(q.v) AS v FROM m p, o JOIN m q ON q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY 1, 2)
SELECT p.y, p.x, round(p.v - k.v, 6) AS top FROM px p JOIN k ON p.y = k.y AND p.x = k.x"""


def _relabel(s, d):
    return raster.relabel(lab(s, d))


def _lut(s, d):
    labels = lab(s, d)
    return raster.apply_lut(labels, raster.relabel(labels)).select("id", "label")


def _largest(s, d):
    return raster.largest_component(lab(s, d)).select("id", "label")


def _tiles(s, d):
    return raster.in_tiles(px(s, d), (1, 32, 32), (0, 4, 4)).groupBy("ty", "tx").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("owned"))


def _chunks(s, d):
    return raster.overlapping_chunks(px(s, d), (1, 40, 40), 8).groupBy("cy", "cx").agg(F.count("*").alias("n"))


def _combine(s, d):
    v = F.col("v")
    p = px(s, d).select("id", *(levels.combine_responses(v / 10, F.sqrt(v), v, sigma).alias(n) for n, sigma in (("fine", 1.0), ("coarse", 2.0))))
    return p.select("id", *r6("fine", "coarse"))


def _profile(s, d):
    return levels.z_profile(px3(s, d), "v", 75).select("z", *r6("level", "fitted"))


def _betti(s, d):
    b0 = lab(s, d, True).agg(F.count_distinct("label").alias("b0"))
    empty = px(s, d).join(fg(s, d).select("id"), "id", "left_anti")
    holes = raster.components(empty).agg(F.count_distinct("label").alias("background"))
    return b0.crossJoin(holes)  # one row each


PAIR = ("a AS (SELECT y, x FROM fg), b AS (SELECT y, x FROM px WHERE event_type = 'purchase')", lambda s, d: (fg(s, d), reference(s, d)))


def _pair(f):
    return lambda s, d: f(*PAIR[1](s, d)).select(*OUT)


# This mask percolates, so labels spread by minimum instead of by reachable pairs.
KEYED = f"""WITH RECURSIVE {PX}, {FG}, {N8}, e AS (SELECT p.id AS a, q.id AS b FROM fg p CROSS JOIN n8 o JOIN fg q ON q.y = p.y + o.dy AND q.x = p.x + o.dx WHERE p.id <> q.id),
lab(id, label) USING KEY (id) AS (SELECT id, id FROM fg UNION SELECT e.b, min(t.label) FROM lab t JOIN e ON t.id = e.a JOIN recurring.lab r ON r.id = e.b WHERE t.label < r.label GROUP BY e.b) SELECT id, label FROM lab"""
ERODE = "SELECT y + dy AS y, x + dx AS x FROM fg, {n} GROUP BY 1, 2 HAVING count(*) = {k}"

_REGISTERED = {
    "foreground_threshold_percentile": (
        lambda s, d: levels.foreground_threshold(px(s, d), "v", 60).select(*r6("threshold"), "samples"),
        "SELECT round(CASE WHEN count(*) > 1000 THEN greatest(quantile_cont(value, 0.6), 1e-5) ELSE 1e9 END, 6) AS threshold, count(*) AS samples FROM events WHERE value > 0",
    ),
    "global_normalize": (
        lambda s, d: levels.global_normalize(px(s, d), "v", 95).select("id", *r6("normalized")),
        f"WITH {PX} SELECT id, round(v / (SELECT greatest(quantile_cont(v, 0.95), 1e-9) FROM px WHERE y % 8 = 0 AND x % 8 = 0 AND v > 0), 6) AS normalized FROM px",
    ),
    "z_profile_normalize": (
        _profile,
        f"""WITH {PX3}, h AS (SELECT z, CAST(z AS DOUBLE) AS t, quantile_cont(v, 0.75) AS level FROM px WHERE v > 0 GROUP BY z),
m AS (SELECT count(*)::DOUBLE s0, sum(t) s1, sum(t*t) s2, sum(t*t*t) s3, sum(t*t*t*t) s4, sum(level) t0, sum(t*level) t1, sum(t*t*level) t2, quantile_cont(level, 0.1) fl FROM h),
k AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS d, t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2) AS d0, s0*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2) AS d1, s0*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2) AS d2 FROM m)
SELECT z, round(level, 6) AS level, round(greatest(CASE WHEN d = 0 THEN level ELSE (d0 + d1*t + d2*t*t) / d END, fl), 6) AS fitted FROM h, k""",
    ),
    "strided_sample_stats": (
        lambda s, d: levels.strided(px(s, d), y=8, x=4).groupBy("y").agg(F.count("*").alias("n"), F.round(levels.percentile("v", 50), 6).alias("median")),
        f"WITH {PX} SELECT y, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS median FROM px WHERE y % 8 = 0 AND x % 4 = 0 GROUP BY y",
    ),
    "every_kth_row": (
        lambda s, d: levels.every_kth(px(s, d), "x", 5, ("y",)).select("id"),
        f"WITH {PX} SELECT id FROM px QUALIFY row_number() OVER (PARTITION BY y ORDER BY x) % 5 = 1",
    ),
    "combine_scale_responses": (_combine, "SELECT event_id AS id, round(greatest(value / 10, sqrt(value)), 6) AS fine, round(greatest(value / 10, sqrt(value)) * value, 6) AS coarse FROM events"),
    "otsu_threshold": (_otsu, f"WITH {PX}, q AS (SELECT v AS u FROM px), {otsu_sql('q')} SELECT round(threshold, 6) AS threshold FROM t"),
    "hull_level_log_otsu": (_log_hull, f"WITH {PX}, q AS (SELECT ln(1 + v) AS u FROM px WHERE v > 0), {otsu_sql('q')} SELECT round(exp(threshold * 0.8::DOUBLE) - 1, 6) AS threshold FROM t"),
    "reference_threshold": (
        lambda s, d: levels.otsu(px(s, d), "v").crossJoin(px(s, d).agg(F.max("v").alias("top"))).select(F.round(levels.reference_threshold(F.col("threshold"), F.lit(1.0), F.col("top"), 1.5), 6).alias("cutoff")),
        f"WITH {PX}, q AS (SELECT v AS u FROM px), {otsu_sql('q')} SELECT round(CASE WHEN (SELECT max(v) FROM px) > 5 THEN threshold ELSE 1.0 END * 1.5::DOUBLE, 6) AS cutoff FROM t",
    ),
    "dilate_rank1": (_mask(lambda m: raster.dilate(m, raster.cross())), f"WITH {PX}, {FG}, {N4} SELECT DISTINCT y + dy AS y, x + dx AS x FROM fg, n4"),
    "dilate_box": (_mask(lambda m: raster.dilate(m, raster.box())), f"WITH {PX}, {FG}, {N8} SELECT DISTINCT y + dy AS y, x + dx AS x FROM fg, n8"),
    "dilate_disk2": (_mask(lambda m: raster.dilate(m, raster.ball(2))), _dilate_sql(_ball_sql(2))),
    "erode_rank1": (_mask(lambda m: raster.erode(m, raster.cross())), f"WITH {PX}, {FG}, {N4} " + ERODE.format(n="n4", k=5)),
    "binary_closing_box": (
        _mask(lambda m: raster.close_gaps(m, raster.box())),
        f"WITH {PX}, {FG}, {N8}, g AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM fg, n8) SELECT y + dy AS y, x + dx AS x FROM g, n8 GROUP BY 1, 2 HAVING count(*) = 9",
    ),
    "binary_opening_rank1": (
        _mask(lambda m: raster.open_spots(m, raster.cross())),
        f"WITH {PX}, {FG}, {N4}, g AS (SELECT y + dy AS y, x + dx AS x FROM fg, n4 GROUP BY 1, 2 HAVING count(*) = 5) SELECT DISTINCT y + dy AS y, x + dx AS x FROM g, n4",
    ),
    "clamped_z_erosion": (
        _z_erosion,
        f"""WITH {PX3}, {FG}, i AS (SELECT a.z, a.y, a.x FROM fg a JOIN fg u ON u.z = a.z + 1 AND u.y = a.y AND u.x = a.x JOIN fg l ON l.z = a.z - 1 AND l.y = a.y AND l.x = a.x),
m AS (SELECT y, x, (min(z) + max(z)) // 2 AS z FROM fg WHERE (y, x) NOT IN (SELECT (y, x) FROM i) GROUP BY y, x)
SELECT z, y, x FROM i UNION ALL SELECT m.z, m.y, m.x FROM m JOIN fg USING (z, y, x)""",
    ),
    "surface_voxels": (
        _mask(lambda m: raster.surface(m)),
        f"WITH {PX}, {FG}, {N4} SELECT y, x FROM fg EXCEPT (" + ERODE.format(n="n4", k=5) + ")",
    ),
    "connected_components_4": (_components(False), f"WITH RECURSIVE {PX}, {FG}, {N4}, {labels_sql()} SELECT id, label FROM lab"),
    "connected_components_8": (_components(True), KEYED),
    "component_size_filter": (
        lambda s, d: raster.size_filter(lab(s, d), 5).select("id", "label"),
        f"WITH RECURSIVE {PX}, {FG}, {N4}, {labels_sql()} SELECT id, label FROM lab QUALIFY count(*) OVER (PARTITION BY label) >= 5",
    ),
    "largest_component": (
        _largest,
        f"WITH RECURSIVE {PX}, {FG}, {N4}, {labels_sql()} SELECT id, label FROM lab WHERE label = (SELECT label FROM lab GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)",
    ),
    "relabel_sequential": (_relabel, f"WITH RECURSIVE {PX}, {FG}, {N4}, {labels_sql()} SELECT label, row_number() OVER (ORDER BY label) AS new_label FROM (SELECT DISTINCT label FROM lab)"),
    "lut_remap": (_lut, f"WITH RECURSIVE {PX}, {FG}, {N4}, {labels_sql()} SELECT id, dense_rank() OVER (ORDER BY label) AS label FROM lab"),
    "label_histogram": (
        lambda s, d: lab(s, d).groupBy("label").agg(F.count("*").alias("n")),
        f"WITH RECURSIVE {PX}, {FG}, {N4}, {labels_sql()} SELECT label, count(*) AS n FROM lab GROUP BY label",
    ),
    "hole_fill": (
        _holes,
        f"""WITH RECURSIVE {PX}, {N4}, bg AS (SELECT * FROM px WHERE v <= (SELECT quantile_cont(v, 0.4) FROM px)), {labels_sql('bg')},
o AS (SELECT DISTINCT label FROM lab WHERE y = 0 OR x = 0 OR y = (SELECT max(y) FROM px) OR x = (SELECT max(x) FROM px)) SELECT id FROM lab WHERE label NOT IN (SELECT label FROM o)""",
    ),
    "zero_edge_trim": (
        _trim_zero,
        f"WITH {PX}, {FG} SELECT id FROM fg WHERE NOT EXISTS (SELECT 1 FROM px q WHERE q.v < 1.0 AND q.y BETWEEN fg.y - 1 AND fg.y + 1 AND q.x BETWEEN fg.x - 1 AND fg.x + 1)",
    ),
    "edge_trim_core_protection": (
        _trim_edge,
        f"""WITH {PX}, {FG}, core AS (SELECT y, x FROM px WHERE v > (SELECT quantile_cont(v, 0.95) FROM px))
SELECT id FROM fg WHERE NOT (EXISTS (SELECT 1 FROM px q WHERE q.event_type = 'purchase' AND q.y BETWEEN fg.y - 1 AND fg.y + 1 AND q.x BETWEEN fg.x - 1 AND fg.x + 1)
AND NOT EXISTS (SELECT 1 FROM core c WHERE c.y BETWEEN fg.y - 2 AND fg.y + 2 AND c.x BETWEEN fg.x - 2 AND fg.x + 2 AND abs(c.y - fg.y) + abs(c.x - fg.x) <= 2))""",
    ),
    "edt_distance": (
        _edt,
        f"WITH {PX}, f AS (SELECT y AS fy, x AS fx FROM px WHERE event_type = 'purchase') SELECT y, x, round(sqrt(min((y - fy) * (y - fy) + (x - fx) * (x - fx))::DOUBLE), 6) AS distance FROM px, f GROUP BY y, x",
    ),
    "edt_nearest_id": (
        _edt_nearest,
        f"WITH {PX}, f AS (SELECT y AS fy, x AS fx FROM px WHERE event_type = 'purchase') SELECT y, x, round(sqrt(min((y - fy) * (y - fy) + (x - fx) * (x - fx))::DOUBLE), 6) AS distance FROM px, f GROUP BY y, x",
    ),
    "population_thickness": (
        lambda s, d: raster.distance_transform(px(s, d), px(s, d).join(fg(s, d).select("id"), "id", "left_anti")).join(blocks(s, d).select(*AXES, "label"), list(AXES)).groupBy("label").agg(F.round(F.max("distance"), 6).alias("thickness")),
        f"WITH {PX}, {FG}, b AS (SELECT y AS fy, x AS fx FROM px WHERE id NOT IN (SELECT id FROM fg)), m AS (SELECT (y // 5) * 20 + x // 5 + 1 AS label, y, x, min((y - fy) * (y - fy) + (x - fx) * (x - fx)) AS q FROM fg, b GROUP BY ALL) SELECT label, round(sqrt(max(q)::DOUBLE), 6) AS thickness FROM m GROUP BY label",
    ),
    "gaussian_smooth": (_gauss, _gauss_sql()),
    "white_tophat": (lambda s, d: kernels.white_tophat(px(s, d), "v", 2, tile=64).select("y", "x", *r6("top")), _tophat_sql()),
    "frangi_response": (lambda s, d: kernels.vesselness(px(s, d), "v", "frangi", [1.0, 2.0]).select("y", "x", *r6("response")), None),
    "sato_response": (lambda s, d: kernels.vesselness(px(s, d), "v", "sato", [1.0, 2.0]).select("y", "x", *r6("response")), None),
    "mask_or": (_pair(raster.mask_or), f"WITH {PX}, {FG}, {PAIR[0]} SELECT * FROM a UNION SELECT * FROM b"),
    "mask_and": (_pair(raster.mask_and), f"WITH {PX}, {FG}, {PAIR[0]} SELECT * FROM a INTERSECT SELECT * FROM b"),
    "mask_andnot": (_pair(raster.mask_minus), f"WITH {PX}, {FG}, {PAIR[0]} SELECT * FROM a EXCEPT SELECT * FROM b"),
    "mask_xor": (_pair(raster.mask_xor), f"WITH {PX}, {FG}, {PAIR[0]} (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)"),
    "downsample_mask": (_mask(lambda m: raster.downsample(m, 4)), f"WITH {PX}, {FG} SELECT y // 4 AS y, x // 4 AS x FROM fg WHERE y % 4 = 0 AND x % 4 = 0"),
    "upsample_mask": (_mask(lambda m: raster.upsample(raster.downsample(m, 4), 4)), f"WITH {PX}, {FG} SELECT (y // 4) * 4 + i AS y, (x // 4) * 4 + j AS x FROM fg, range(4) a(i), range(4) b(j) WHERE y % 4 = 0 AND x % 4 = 0"),
    "tile_halo_plan": (
        _tiles,
        f"WITH {PX} SELECT ty, tx, count(*) AS n, CAST(sum(CASE WHEN y // 32 = ty AND x // 32 = tx THEN 1 ELSE 0 END) AS BIGINT) AS owned FROM (SELECT y, x, unnest(range(greatest(0, CAST(floor((y - 4) / 32) AS BIGINT)), (y + 4) // 32 + 1)) AS ty FROM px) JOIN (SELECT DISTINCT x AS xx, unnest(range(greatest(0, CAST(floor((x - 4) / 32) AS BIGINT)), (x + 4) // 32 + 1)) AS tx FROM px) ON x = xx GROUP BY ty, tx",
    ),
    "overlapping_chunk_plan": (
        _chunks,
        f"WITH {PX}, c AS (SELECT unnest(range(0, (SELECT max(greatest(y, x)) FROM px) // 32 + 1)) AS c) SELECT a.c AS cy, b.c AS cx, count(*) AS n FROM px JOIN c a ON y >= a.c * 32 AND y < a.c * 32 + 40 JOIN c b ON x >= b.c * 32 AND x < b.c * 32 + 40 GROUP BY 1, 2",
    ),
    "betti_numbers": (
        _betti,
        f"WITH RECURSIVE {PX}, {FG}, {N4}, {N8}, empty AS (SELECT * FROM px ANTI JOIN fg USING (id)), {labels_sql(offsets='n8')}, {labels_sql('empty', 'n4', 'bg')} SELECT (SELECT count(DISTINCT label) FROM lab) AS b0, (SELECT count(DISTINCT label) FROM bg) AS background",
    ),
    "segment_and_measure": (
        segment_and_measure,
        f"""WITH RECURSIVE {PX}, {FG}, {N4}, {labels_sql()} SELECT label, count(*) AS pixel_count, count(*)::DOUBLE AS area_um2, round(avg(v), 6) AS mean_intensity, round(median(v), 6) AS median_intensity,
round(stddev_pop(v), 6) AS std_intensity, round(sum(v), 6) AS integrated_density, round(max(v), 6) AS max_intensity, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max FROM lab GROUP BY label HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 20""",
    ),
}
# The background percolates: its components are held against brute force in the tests instead.
QUERIES = {k: q for k, (q, _) in _REGISTERED.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in _REGISTERED.items() if sql}
