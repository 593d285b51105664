"""Queries of measurement and interaction operators over the raster views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import interaction, kernels, measure, raster
from ..operators.raster import AXES
from .views import BLOCKS, FG, N4, N6, N8, PX, PX3, REF, blocks, fg, lab, labels_sql, px, r6, reference

LAB = f"{PX}, {FG}, {N4}, {labels_sql()}"
SURFACE = "srf AS (SELECT a.label, a.y, a.x FROM {t} a, n4 LEFT JOIN {t} b ON b.label = a.label AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3 HAVING count(b.label) < 5)"


def _solid(s, d):
    """Foreground of the 3D view, labelled by columns of 5 x 5."""
    return fg(s, d, True).withColumn("label", F.expr("(y div 5) * 10 + x div 5 + 1"))


SOLID = f"{PX3}, {FG}, sol AS (SELECT *, (y // 5) * 10 + x // 5 + 1 AS label FROM fg)"


def _tiles_sql(axis: str, size: int) -> str:
    return f"{axis}t AS (SELECT label, t0{axis}, least(t0{axis} + {size}, hi) AS t1{axis}, greatest(lo, t0{axis} - 1) AS p0{axis}, least(hi, least(t0{axis} + {size}, hi) + 1) AS p1{axis} FROM (SELECT label, lo, hi, unnest(range(lo, hi, {size})) AS t0{axis} FROM (SELECT label, min({axis}) AS lo, max({axis}) + 1 AS hi FROM sol GROUP BY 1)))"


OBJECT_TILES = f"WITH {SOLID}, {_tiles_sql('z', 2)}, {_tiles_sql('y', 2)}, {_tiles_sql('x', 3)} SELECT * FROM zt JOIN yt USING (label) JOIN xt USING (label)"


def _faces(s, d):
    t = measure.shape_3d(_solid(s, d), (2.0, 1.0, 1.0))
    return t.select("label", "voxel_count", *r6("volume_um3", "surface_area_um2", "sphericity"))


def _faces_sql() -> str:
    pair = "SELECT a.label, count(*) AS n FROM sol a JOIN sol b ON b.label = a.label AND b.z = a.z + {} AND b.y = a.y + {} AND b.x = a.x + {} GROUP BY 1"
    return f"""WITH {SOLID}, c AS (SELECT label, count(*) AS n FROM sol GROUP BY 1), pz AS ({pair.format(1, 0, 0)}), py AS ({pair.format(0, 1, 0)}), qx AS ({pair.format(0, 0, 1)}),
f AS (SELECT c.label, c.n, 2 * (c.n - coalesce(pz.n, 0)) fz, 2 * (c.n - coalesce(py.n, 0)) fy, 2 * (c.n - coalesce(qx.n, 0)) fx FROM c LEFT JOIN pz USING (label) LEFT JOIN py USING (label) LEFT JOIN qx USING (label)),
g AS (SELECT label, n, n * 2.0::DOUBLE AS v, fz * 2.0::DOUBLE + fy * 2.0::DOUBLE + fx * 1.0::DOUBLE AS a FROM f)
SELECT label, n AS voxel_count, round(v, 6) AS volume_um3, round(a, 6) AS surface_area_um2, round(pow(pi(), 1.0::DOUBLE / 3) * pow(6 * v, 2.0::DOUBLE / 3) / a, 6) AS sphericity FROM g"""


def _perimeter(s, d):
    t = measure.size(blocks(s, d), (1.0, 2.0, 0.5), dims=2).join(measure.perimeter(blocks(s, d), (1.0, 2.0, 0.5)), "label")
    return t.select("label", *r6("area_um2", "perimeter_um"), F.round(F.least(F.lit(1.0), 4 * F.pi() * F.col("area_um2") / F.pow("perimeter_um", F.lit(2))), 6).alias("circularity"))


PERIMETER = f"""WITH {PX}, {FG}, {BLOCKS}, c AS (SELECT label, y + dy AS cy, x + dx AS cx, sum(w) AS code FROM blk, (VALUES (0, 0, 1), (0, -1, 2), (-1, 0, 4), (-1, -1, 8)) k(dy, dx, w) GROUP BY 1, 2, 3),
p AS (SELECT label, sum(CASE WHEN code IN (1, 2, 4, 8, 7, 11, 13, 14) THEN 0.5 * sqrt(4.25::DOUBLE) WHEN code IN (6, 9) THEN sqrt(4.25::DOUBLE) WHEN code IN (3, 12) THEN 0.5::DOUBLE WHEN code IN (5, 10) THEN 2.0::DOUBLE ELSE 0 END) AS p FROM c GROUP BY 1),
a AS (SELECT label, count(*)::DOUBLE AS a FROM blk GROUP BY 1) SELECT label, round(a, 6) AS area_um2, round(p, 6) AS perimeter_um, round(least(1.0, 4 * pi() * a / (p * p)), 6) AS circularity FROM a JOIN p USING (label)"""


PAIRS = "pr AS (SELECT a.label AS a, b.label AS b, a.y AS ay, a.x AS ax, b.y AS yb, b.x AS xb, CAST(sqrt(((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))::DOUBLE) AS FLOAT) AS d FROM srf a JOIN srf b ON a.label <> b.label)"


#: Surface pixels of all labelled objects.
ALL = f"{LAB}, {SURFACE.format(t='lab')}"


def _nearest(s, d):
    return measure.nearest_objects(lab(s, d), dims=2).select("label", "closest_neighbor_label", F.round(F.col("shortest_distance_um").cast("double"), 4).alias("shortest_distance_um"))


def _contacts(s, d):
    t = measure.contact_points(measure.nearest_objects(lab(s, d), dims=2))
    return t.select("mask1", "mask2", "mask1_y", "mask1_x", "mask2_y", "mask2_x")


def _matrix(s, d):
    """Rounded by floor(), which for doubles made of 32 bits gives what round() does in a tenth of its time."""
    t = measure.distance_matrix(lab(s, d), dims=2)
    return t.select("label_a", "label_b", (F.floor(F.col("distance_um").cast("double") * 10000 + 0.5) / 10000).alias("distance_um"))


def _embedding_nn(s, d):
    """Each label's mean vector and its nearest other label: a matrix over a fixed number of groups."""
    e = s.read.parquet(f"{d}/embeddings.parquet").where("label is not null").select("label", F.posexplode("embedding").alias("k", "v"))
    mean = e.groupBy("label", "k").agg(F.avg("v").alias("v"))
    pairs = mean.alias("a").join(mean.alias("b"), "k").where("a.label != b.label").groupBy(F.col("a.label").alias("label"), F.col("b.label").alias("other")).agg(F.sqrt(F.sum((F.col("a.v") - F.col("b.v")) * (F.col("a.v") - F.col("b.v")))).alias("d"))
    return pairs.groupBy("label").agg(F.min(F.struct(F.round("d", 6).alias("d"), F.col("other").alias("o"))).alias("m")).select("label", F.col("m.d").alias("distance"), F.col("m.o").alias("nearest"))


def _overlap(s, d):
    t = interaction.overlap_per_primary(blocks(s, d), reference(s, d), "ref", dims=2)
    return t.select("label", *r6("overlap_area_um2_ref", "overlap_fraction_ref", "overlap_fraction_of_partner_ref"), "overlaps_any_ref", F.col("dominant_overlap_id_ref").cast("long").alias("dominant_overlap_id_ref"))


OVERLAP = f"""WITH {PX}, {FG}, {BLOCKS}, {REF}, p AS (SELECT label, ref_label, count(*) AS n FROM blk JOIN ref USING (y, x) GROUP BY 1, 2), t AS (SELECT label, sum(n) AS n FROM p GROUP BY 1),
b AS (SELECT label, ref_label, n AS tn FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, ref_label) = 1), r AS (SELECT ref_label, count(*) AS rn FROM ref GROUP BY 1), c AS (SELECT label, count(*) AS cn FROM blk GROUP BY 1)
SELECT label, round(coalesce(n, 0)::DOUBLE, 6) AS overlap_area_um2_ref, round(coalesce(n, 0)::DOUBLE / cn, 6) AS overlap_fraction_ref, round(coalesce(tn::DOUBLE / rn, 0), 6) AS overlap_fraction_of_partner_ref, coalesce(n, 0) > 0 AS overlaps_any_ref, coalesce(ref_label, 0) AS dominant_overlap_id_ref
FROM c LEFT JOIN t USING (label) LEFT JOIN b USING (label) LEFT JOIN r USING (ref_label)"""


def _coverage(s, d):
    t = interaction.coverage(blocks(s, d), reference(s, d), dims=2)
    return t.select("ref_label", *r6("total_overlap_area_um2", "ref_total_area_um2", "percent_covered"), "interacting_cell_count", F.array_join("interacting_labels", ",").alias("interacting_labels"))


COVERAGE = f"""WITH {PX}, {FG}, {BLOCKS}, {REF}, p AS (SELECT ref_label, label, count(*) AS n FROM blk JOIN ref USING (y, x) GROUP BY 1, 2), r AS (SELECT ref_label, count(*) AS rn FROM ref GROUP BY 1)
SELECT ref_label, round(sum(n)::DOUBLE, 6) AS total_overlap_area_um2, round(any_value(rn)::DOUBLE, 6) AS ref_total_area_um2, round(100.0::DOUBLE * sum(n) / any_value(rn), 6) AS percent_covered, count(*) AS interacting_cell_count, string_agg(label::VARCHAR, ',' ORDER BY label) AS interacting_labels FROM p JOIN r USING (ref_label) GROUP BY 1"""


def _to_reference(s, d):
    t = interaction.distance_to_reference(blocks(s, d), reference(s, d), "ref", dims=2)
    return t.select("label", F.round(F.col("dist_to_nearest_ref_um").cast("double"), 4).alias("distance"), F.col("nearest_ref_id").cast("long").alias("nearest_ref_id"))


TO_REFERENCE = f"""WITH {PX}, {FG}, {BLOCKS}, {REF}, p AS (SELECT b.label, b.y, b.x, r.ref_label, CAST(sqrt(((b.y - r.y) * (b.y - r.y) + (b.x - r.x) * (b.x - r.x))::DOUBLE) AS FLOAT) AS d FROM blk b, ref r)
SELECT label, round(d::DOUBLE, 4) AS distance, ref_label AS nearest_ref_id FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, y, x, ref_label) = 1"""


def _cross(s, d):
    """Between rows of blocks: two channels with a fixed number of objects each."""
    band = lambda t: t.withColumn("label", F.expr("x div 10 + 1"))
    t = interaction.cross_distances(band(fg(s, d)), band(reference(s, d)), dims=2)
    return t.select("channel_a_label", "channel_b_label", F.round(F.col("distance_um").cast("double"), 4).alias("distance_um"))


def _surface_sql(source: str, name: str) -> str:
    return f"{name}0 AS (SELECT y, x, x // 10 + 1 AS label FROM {source}), {name} AS (SELECT a.label, a.y, a.x FROM {name}0 a, n4 LEFT JOIN {name}0 b ON b.label = a.label AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3 HAVING count(b.label) < 5)"


CROSS = f"""WITH {PX}, {FG}, {N4}, rf AS (SELECT * FROM px WHERE event_type = 'purchase'), {_surface_sql('fg', 'a')}, {_surface_sql('rf', 'b')}
SELECT a.label AS channel_a_label, b.label AS channel_b_label, round(CAST(sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))::DOUBLE) AS FLOAT)::DOUBLE, 4) AS distance_um FROM a, b GROUP BY 1, 2"""


def _regions(s, d):
    return interaction.overlap_regions(fg(s, d).withColumn("label", F.lit(1)), reference(s, d)).select("id", "label")


def _segments(s, d):
    """Cells are blocks of 10 x 10, their segments blocks of 5 x 5."""
    return fg(s, d).withColumn("cell", F.expr("(y div 10) * 10 + x div 10")).withColumn("label", F.expr("((y div 5) % 2) * 2 + (x div 5) % 2 + 1"))


SEG = f"{PX}, {FG}, seg AS (SELECT *, (y // 10) * 10 + x // 10 AS cell, ((y // 5) % 2) * 2 + (x // 5) % 2 + 1 AS label FROM fg)"
FACE = "face AS (SELECT DISTINCT p.cell, p.label AS a, q.label AS b, q.y, q.x FROM seg p, n8 JOIN seg q ON q.cell = p.cell AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.label < q.label)"


def _seed_means(s, d):
    return _segments(s, d).where("event_type = 'purchase'").groupBy("cell", "label").agg(F.avg("v").alias("mean"))


def _metrics(s, d):
    return interaction.interface_metrics(_segments(s, d), _seed_means(s, d), 0.6, "v").select("cell", "a", "b", "contact", *r6("ratio"), "bright")


METRICS = f"""WITH {SEG}, {N8}, {FACE}, m AS (SELECT cell, label, avg(v) AS mean FROM seg WHERE event_type = 'purchase' GROUP BY 1, 2),
e AS (SELECT f.cell, f.a, f.b, avg(s.v) AS mean, count(*) AS contact FROM face f JOIN seg s USING (cell, y, x) GROUP BY 1, 2, 3)
SELECT e.cell, a, b, contact, round(e.mean / greatest(coalesce(ma.mean, 0), coalesce(mb.mean, 0), 1e-6), 6) AS ratio, e.mean / greatest(coalesce(ma.mean, 0), coalesce(mb.mean, 0), 1e-6) >= 0.6 AS bright
FROM e LEFT JOIN m ma ON ma.cell = e.cell AND ma.label = e.a LEFT JOIN m mb ON mb.cell = e.cell AND mb.label = e.b"""


def _contrast(s, d):
    t = interaction.local_contrast(_segments(s, d), 2, 0.1, "v", fewest=5)
    return t.select("cell", "a", "b", "n_a", "n_b", *r6("m_a", "m_b"), "distinct_sides")


CONTRAST = f"""WITH {SEG}, {N8}, {FACE}, zone AS (SELECT DISTINCT cell, a, b, y + i AS y, x + j AS x FROM face, range(-2, 3) p(i), range(-2, 3) q(j) WHERE i * i + j * j <= 4),
s AS (SELECT z.cell, z.a, z.b, count(*) FILTER (g.label = z.a) AS n_a, count(*) FILTER (g.label = z.b) AS n_b, avg(g.v) FILTER (g.label = z.a) AS m_a, avg(g.v) FILTER (g.label = z.b) AS m_b FROM zone z JOIN seg g ON g.cell = z.cell AND g.y = z.y AND g.x = z.x AND g.label IN (z.a, z.b) GROUP BY 1, 2, 3)
SELECT cell, a, b, n_a, n_b, round(m_a, 6) AS m_a, round(m_b, 6) AS m_b, coalesce(n_a < 5 OR n_b < 5 OR greatest(coalesce(m_a, 0), coalesce(m_b, 0)) < 1e-6 OR abs(m_a - m_b) / greatest(m_a, m_b, 1e-6) >= 0.1, true) AS distinct_sides FROM s"""


def _rag(s, d):
    nodes, edges = interaction.region_graph(_segments(s, d))
    return edges.join(nodes.select("cell", F.col("label").alias("a"), F.col("volume").alias("volume_a")), ["cell", "a"]).select("cell", "a", "b", "contact", "volume_a")


RAG = f"WITH {SEG}, {N8}, {FACE}, n AS (SELECT cell, label AS a, count(*) AS volume_a FROM seg GROUP BY 1, 2) SELECT cell, a, b, contact, volume_a FROM (SELECT cell, a, b, count(*) AS contact FROM face GROUP BY 1, 2, 3) JOIN n USING (cell, a)"


def _merges(s, d):
    """Segments of a cell whose border is bright join: representatives are the smallest."""
    from ..operators.graph import connected_components

    e = interaction.interface_metrics(_segments(s, d), _seed_means(s, d), 0.6, "v").where("bright")
    node = lambda c: F.col("cell") * 10 + F.col(c)
    return connected_components(e.select(node("a").alias("a"), node("b").alias("b")))


MERGES = METRICS.replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT e.cell", ", g AS (SELECT e.cell", 1) + """ WHERE e.mean / greatest(coalesce(ma.mean, 0), coalesce(mb.mean, 0), 1e-6) >= 0.6),
h AS (SELECT cell * 10 + a AS p, cell * 10 + b AS q FROM g UNION SELECT cell * 10 + b, cell * 10 + a FROM g), w(root, node) AS (SELECT p, p FROM h UNION SELECT w.root, h.q FROM w JOIN h ON w.node = h.p WHERE w.root < h.q)
SELECT node, min(root) AS component FROM w GROUP BY node"""


def _stitch(s, d):
    """Chunks of 40 columns that overlap by 8, each with its own labels; seeds are the purchase pixels' blocks."""
    p = blocks(s, d)
    chunk = lambda lo, hi: p.where(f"x >= {lo} and x < {hi}").withColumn("label", F.expr(f"label * 100 + {lo}"))
    left, right = chunk(0, 54), chunk(46, 100)
    seeds = left.unionByName(right).where("event_type = 'purchase'").groupBy("label").agg(F.sort_array(F.collect_set(F.col("user_id") % 7)).alias("seeds"))
    return interaction.stitch_pairs(left, right, seeds)


STITCH = f"""WITH {PX}, {FG}, {BLOCKS}, l AS (SELECT *, label * 100 AS lb FROM blk WHERE x < 54), r AS (SELECT *, label * 100 + 46 AS lb FROM blk WHERE x >= 46),
s AS (SELECT lb, list(DISTINCT user_id % 7) AS seeds FROM (SELECT * FROM l UNION ALL SELECT * FROM r) WHERE event_type = 'purchase' GROUP BY lb), m AS (SELECT DISTINCT l.lb AS a, r.lb AS b FROM l JOIN r USING (id))
SELECT a, b, NOT (sa.seeds IS NOT NULL AND sb.seeds IS NOT NULL AND NOT coalesce(list_has_any(sa.seeds, sb.seeds), false)) AS merge FROM m LEFT JOIN s sa ON sa.lb = a LEFT JOIN s sb ON sb.lb = b"""


def _orphans(s, d):
    seg = _segments(s, d)
    return interaction.orphan_targets(seg.where("label = 1").withColumnRenamed("label", "fragment"), seg.where("label > 1"))


ORPHANS = f"""WITH {SEG}, {N8}, rim AS (SELECT DISTINCT cell, label AS fragment, y + dy AS y, x + dx AS x FROM seg, n8 WHERE label = 1 AND (dy <> 0 OR dx <> 0)),
m AS (SELECT r.cell, fragment, g.label AS target, count(*) AS n FROM rim r JOIN seg g ON g.cell = r.cell AND g.y = r.y AND g.x = r.x WHERE g.label > 1 GROUP BY 1, 2, 3) SELECT cell, fragment, target FROM m QUALIFY row_number() OVER (PARTITION BY cell, fragment ORDER BY n DESC, target) = 1"""


def _multi(s, d):
    t = interaction.multi_seed_cells(blocks(s, d), px(s, d).where("event_type = 'purchase'").withColumn("label", F.col("user_id")))
    return t.select("label", F.array_join("somas", ",").alias("somas"))


MULTI = f"WITH {PX}, {FG}, {BLOCKS} SELECT label, string_agg(u::VARCHAR, ',' ORDER BY u) AS somas FROM (SELECT DISTINCT label, user_id AS u FROM blk WHERE event_type = 'purchase') GROUP BY label HAVING count(*) > 1"


def _merge_outer(s, d):
    b = blocks(s, d)
    t = measure.merge_metrics(measure.size(b, dims=2), measure.depth(b.where("y < x")), measure.intensity(b.where("v > 3"), "v"))
    return t.select("label", "pixel_count", *r6("depth_um", "mean_intensity", "max_intensity"))


MERGE_OUTER = f"""WITH {PX}, {FG}, {BLOCKS} SELECT label, n AS pixel_count, depth_um, mean_intensity, max_intensity FROM (SELECT label, count(*) AS n FROM blk GROUP BY 1) FULL JOIN (SELECT label, round(median(z)::DOUBLE, 6) AS depth_um FROM blk WHERE y < x GROUP BY 1) USING (label)
FULL JOIN (SELECT label, round(avg(v), 6) AS mean_intensity, round(max(v), 6) AS max_intensity FROM blk WHERE v > 3 GROUP BY 1) USING (label)"""


def _merge_left(s, d):
    b = blocks(s, d)
    t = measure.merge_metrics(measure.intensity(b, "v").drop("median_intensity"), measure.intensity(b.where("v > 3"), "v").select("label", "max_intensity", "std_intensity"), how="left")
    return t.select("label", *r6("mean_intensity", "integrated_density", "max_intensity", "std_intensity"))


MERGE_LEFT = f"""WITH {PX}, {FG}, {BLOCKS} SELECT label, mean_intensity, integrated_density, max_intensity, std_intensity FROM (SELECT label, round(avg(v), 6) AS mean_intensity, round(sum(v), 6) AS integrated_density FROM blk GROUP BY 1) LEFT JOIN (SELECT label, round(max(v), 6) AS max_intensity, round(stddev_pop(v), 6) AS std_intensity FROM blk WHERE v > 3 GROUP BY 1) USING (label)"""


#: The hull's area from its edges: pairs of pixel corners with all others on one side, or between them.
HULLS = f"""WITH {PX}, {FG}, {BLOCKS}, pts AS (SELECT DISTINCT label, y + dy AS y, x + dx AS x FROM blk, (VALUES (-0.5::DOUBLE, -0.5::DOUBLE), (-0.5, 0.5), (0.5, -0.5), (0.5, 0.5)) k(dy, dx)),
edge AS (SELECT p.label, p.y AS py, p.x AS px_, q.y AS qy, q.x AS qx FROM pts p JOIN pts q USING (label) JOIN pts r USING (label) WHERE p.y <> q.y OR p.x <> q.x GROUP BY ALL
HAVING bool_and((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) > 0 OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND (q.x - p.x) * (r.x - p.x) + (q.y - p.y) * (r.y - p.y) BETWEEN 0 AND (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)))),
hull AS (SELECT label, abs(sum(px_ * qy - qx * py)) / 2 AS area FROM edge GROUP BY label),
c AS (SELECT label, y + dy AS cy, x + dx AS cx, sum(w) AS code FROM blk, (VALUES (0, 0, 1), (0, -1, 2), (-1, 0, 4), (-1, -1, 8)) k(dy, dx, w) GROUP BY 1, 2, 3),
p AS (SELECT label, sum(CASE WHEN code IN (1, 2, 4, 8, 7, 11, 13, 14) THEN sqrt(2.0::DOUBLE) / 2 WHEN code IN (6, 9) THEN sqrt(2.0::DOUBLE) WHEN code IN (3, 12, 5, 10) THEN 1.0::DOUBLE ELSE 0 END) AS p FROM c GROUP BY 1), a AS (SELECT label, count(*) AS n FROM blk GROUP BY 1)
SELECT label, n AS pixel_count, round(least(1.0::DOUBLE, n / area), 6) AS solidity, round(least(1.0::DOUBLE, 4 * pi() * n / (p * p)), 6) AS circularity FROM a JOIN hull USING (label) JOIN p USING (label)"""
GIVEN_SKELETON = f"""WITH {PX}, {FG}, {BLOCKS}, {N8}, g AS (SELECT a.label, a.y, a.x, count(*) - 1 AS n FROM blk a, n8 JOIN blk b ON b.label = a.label AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3),
c AS (SELECT label, count(*) FILTER (n = 1) AS e, count(*) FILTER (n >= 3) AS j, count(*) AS v FROM g GROUP BY 1) SELECT label, e AS true_num_endpoints, j AS true_num_junctions, v AS skan_num_skeleton_voxels, greatest(0, e - 1 + j) AS true_num_branches FROM c"""


def _watershed(s, d):
    cells = blocks(s, d).withColumn("seed", F.when(F.col("event_type") == "purchase", F.col("id") + 1))
    return kernels.split_cells(cells, "v", 0.5).groupBy("label", "segment").agg(F.count("*").alias("n"))


def _skeletons(s, d):
    return measure.skeleton_counts(kernels.skeletonize(raster.size_filter(lab(s, d, True), 8), prune_um=2.0))


def _regular_seeds(s, d):
    from ..operators import seeds

    return seeds.extract_seeds(raster.size_filter(lab(s, d), 8), "v", least_fragment=3, separation_um=3.0, least_thickness=1.0).groupBy("seed").agg(F.count("*").alias("n"), F.min("label").alias("label"))


_REGISTERED = {
    "volume_area": (lambda s, d: measure.size(_solid(s, d), (2.0, 0.5, 0.5)).select("label", "voxel_count", *r6("volume_um3")), f"WITH {SOLID} SELECT label, count(*) AS voxel_count, round(count(*) * 0.5::DOUBLE, 6) AS volume_um3 FROM sol GROUP BY label"),
    "depth_median": (lambda s, d: measure.depth(_solid(s, d), 2.0).select("label", *r6("depth_um")), f"WITH {SOLID} SELECT label, round(median(z) * 2.0::DOUBLE, 6) AS depth_um FROM sol GROUP BY label"),
    "intensity_stats": (
        lambda s, d: measure.intensity(blocks(s, d), "v").select("label", *r6("mean_intensity", "median_intensity", "std_intensity", "integrated_density", "max_intensity")),
        f"WITH {PX}, {FG}, {BLOCKS} SELECT label, round(avg(v), 6) AS mean_intensity, round(median(v), 6) AS median_intensity, round(stddev_pop(v), 6) AS std_intensity, round(sum(v), 6) AS integrated_density, round(max(v), 6) AS max_intensity FROM blk GROUP BY label",
    ),
    "bbox_centroid": (
        lambda s, d: measure.boxes(lab(s, d)).select("label", "y_min", "y_max", "x_min", "x_max", *r6("y_mean", "x_mean")),
        f"WITH RECURSIVE {LAB} SELECT label, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max, round(avg(y), 6) AS y_mean, round(avg(x), 6) AS x_mean FROM lab GROUP BY label",
    ),
    "object_tile_plan": (lambda s, d: raster.object_tiles(_solid(s, d), (2, 2, 3), 1), OBJECT_TILES),
    "exposed_faces_area": (_faces, _faces_sql()),
    "perimeter_circularity": (_perimeter, PERIMETER),
    "eccentricity_moments": (
        lambda s, d: measure.eccentricity(blocks(s, d)).select("label", F.round("eccentricity", 5).alias("eccentricity")),
        f"WITH {PX}, {FG}, {BLOCKS}, m AS (SELECT label, var_pop(y) + 1.0::DOUBLE / 12 AS a, var_pop(x) + 1.0::DOUBLE / 12 AS b, covar_pop(y, x) AS c FROM blk GROUP BY label), r AS (SELECT label, (a + b) / 2 AS h, sqrt(pow((a - b) / 2, 2) + c * c) AS q FROM m) SELECT label, round(sqrt(greatest(0.0::DOUBLE, 1 - (h - q) / (h + q))), 5) AS eccentricity FROM r",
    ),
    "solidity_hull": (lambda s, d: measure.shape_2d(blocks(s, d)).select("label", "pixel_count", *r6("solidity", "circularity")), HULLS),
    "nearest_neighbor": (
        _nearest,
        f"WITH RECURSIVE {ALL}, {PAIRS} SELECT a AS label, b AS closest_neighbor_label, round(d::DOUBLE, 4) AS shortest_distance_um FROM pr QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1",
    ),
    "contact_points": (
        _contacts,
        f"WITH RECURSIVE {ALL}, {PAIRS} SELECT a AS mask1, b AS mask2, ay::DOUBLE AS mask1_y, ax::DOUBLE AS mask1_x, yb::DOUBLE AS mask2_y, xb::DOUBLE AS mask2_x FROM pr QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b, ay, ax, yb, xb) = 1",
    ),
    "pairwise_distance_matrix": (_matrix, f"WITH RECURSIVE {ALL}, {PAIRS} SELECT a AS label_a, b AS label_b, round(min(d)::DOUBLE, 4) AS distance_um FROM pr WHERE a < b GROUP BY 1, 2"),
    "centroid_nearest_label": (
        _embedding_nn,
        "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(v) AS v FROM e GROUP BY 1, 2), p AS (SELECT a.label, b.label AS other, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS distance FROM m a JOIN m b USING (k) WHERE a.label <> b.label GROUP BY 1, 2) SELECT label, distance, other AS nearest FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, other) = 1",
    ),
    "cross_channel_distances": (_cross, CROSS),
    "overlap_per_primary": (_overlap, OVERLAP),
    "reference_coverage": (_coverage, COVERAGE),
    "distance_to_reference": (_to_reference, TO_REFERENCE),
    "overlap_regions_labeled": (_regions, f"WITH RECURSIVE {PX}, {FG}, {N8}, common AS (SELECT * FROM fg WHERE event_type = 'purchase'), {labels_sql("common", "n8")} SELECT id, label FROM lab"),
    "multi_soma_cells": (_multi, MULTI),
    "rag_edges": (_rag, RAG),
    "interface_metrics": (_metrics, METRICS),
    "local_contrast": (_contrast, CONTRAST),
    "merge_resolution": (_merges, MERGES),
    "seed_aware_stitch": (_stitch, STITCH),
    "orphan_reassign": (_orphans, ORPHANS),
    "metrics_outer_merge": (_merge_outer, MERGE_OUTER),
    "metrics_left_merge_drop": (_merge_left, MERGE_LEFT),
    "skeleton_degree": (
        lambda s, d: measure.skeleton_degrees(blocks(s, d)).select("label", "y", "x", "degree"),
        f"WITH {PX}, {FG}, {BLOCKS}, {N8} SELECT a.label, a.y, a.x, count(*) - 1 AS degree FROM blk a, n8 JOIN blk b ON b.label = a.label AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3",
    ),
    "skeleton_counts_given": (lambda s, d: measure.skeleton_counts(blocks(s, d)), GIVEN_SKELETON),
    "skeleton_stats": (_skeletons, None),
    "marker_watershed": (_watershed, None),
    "seed_placement": (_regular_seeds, None),
    "surface_3d": (
        lambda s, d: raster.surface(_solid(s, d), ("label",), 3).select("label", *AXES),
        f"WITH {SOLID}, {N6} SELECT a.label, a.z, a.y, a.x FROM sol a, n6 LEFT JOIN sol b ON b.label = a.label AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3, 4 HAVING count(b.label) < 7",
    ),
}
QUERIES = {k: q for k, (q, _) in _REGISTERED.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in _REGISTERED.items() if sql}
