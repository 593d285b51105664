"""Small cases with values that were worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellplan.functions import columns as fx
from cellplan.functions import stats
from cellplan.operators import cohort, interaction, kernels, measure, raster
from cellplan.operators.graph import connected_components


def voxels(spark, *objects):
    """objects: (label, list of (z, y, x))."""
    return spark.createDataFrame([(lab, z, y, x) for lab, at in objects for z, y, x in at], "label int, z int, y int, x int")


def box(z, y, x):
    return [(a, b, c) for a in range(z) for b in range(y) for c in range(x)]


def test_box_shape(spark):
    df = voxels(spark, (1, box(2, 3, 4)))
    for weights, area, sphericity in (("reference", 92, 0.694263), ("corrected", 80, 0.798402)):
        r = measure.shape_3d(df, (2.0, 1.0, 1.0), face_weights=weights).first()
        assert (r.voxel_count, r.volume_um3, r.surface_area_um2, r.solidity) == (24, 48, area, 0.0) and abs(r.sphericity - sphericity) < 1e-6
    assert raster.surface(df, ("label",), 3).count() == 24
    assert measure.depth(df, 2.0).first().depth_um == 1.0


def test_cube(spark):
    df = voxels(spark, (1, box(3, 3, 3)))
    f = raster.exposed_faces(df, ("label",)).first()
    assert (f.faces_z, f.faces_y, f.faces_x) == (18, 18, 18) and raster.surface(df, ("label",), 3).count() == 26


def test_neighbours_and_tie(spark):
    df = voxels(spark, (1, [(0, 0, 0), (0, 0, 1)]), (2, [(0, 0, 5)]), (3, [(0, 3, 1)]))
    d = {(r.label_a, r.label_b): r.distance_um for r in measure.distance_matrix(df, (1.0, 1.0, 0.5)).collect()}
    assert d[1, 2] == 2.0 and d[1, 3] == 3.0 and abs(d[2, 3] - math.sqrt(13)) < 1e-5
    n = {r.label: r.closest_neighbor_label for r in measure.nearest_objects(df, (1.0, 1.0, 0.5), reach=0.5).collect()}
    assert n == {1: 2, 2: 1, 3: 1}
    tie = voxels(spark, *((k + 1, [(0, 0, 2 * k)]) for k in range(3)))
    r = measure.nearest_objects(tie).where("label = 2").first()
    assert (r.closest_neighbor_label, r.shortest_distance_um) == (1, 2.0)
    assert measure.nearest_objects(voxels(spark, (1, [(0, 0, 0)]))).count() == 0


def test_intensity(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "label int, intensity double")
    r = measure.intensity(df).first()
    assert (r.mean_intensity, r.median_intensity, r.integrated_density, r.max_intensity) == (2.5, 2.5, 10, 4) and abs(r.std_intensity - 1.118034) < 1e-6


@pytest.mark.parametrize(("at", "spacing", "length"), [(box(1, 1, 1), (1, 1, 1), 2.828427), (box(1, 2, 2), (1, 1, 1), 6.828427), (box(1, 1, 10), (1, 1, 1), 20.828427), (box(1, 1, 10), (1, 2, 0.5), 13.123106)])
def test_perimeter(spark, at, spacing, length):
    assert abs(measure.perimeter(voxels(spark, (1, at)), tuple(map(float, spacing))).first().perimeter_um - length) < 1e-6


def test_connectivity(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 101), (0, 5, 200, 5), (0, 5, 127, 6), (0, 5, 128, 7)], "z int, y int, x int, id long")
    assert raster.components(df).select("label").distinct().count() == 4
    assert raster.components(df, full=True).select("label").distinct().count() == 3


def test_skeleton_plus(spark):
    arms = {(0, 2, k) for k in range(5)} | {(0, k, 2) for k in range(5)}
    r = measure.skeleton_counts(voxels(spark, (1, sorted(arms)))).first()
    assert (r.true_num_endpoints, r.true_num_junctions, r.true_num_branches, r.skan_num_skeleton_voxels) == (4, 5, 8, 9)


def test_clamped_erosion(spark):
    df = voxels(spark, (1, [(z, 0, 0) for z in range(1, 6)] + [(z, 0, 1) for z in (2, 3)] + [(z, 0, 2) for z in (0, 4)]))
    got = sorted((r.x, r.z) for r in raster.clamped_z_erosion(df, 1).collect())
    assert got == [(0, 2), (0, 3), (0, 4), (1, 2)]


def test_overlap(spark):
    p = voxels(spark, (1, [(0, 0, x) for x in range(6)]), (2, [(0, 1, x) for x in range(4)]))
    r = voxels(spark, (1, [(0, y, x) for y in (0, 1) for x in (0, 1)]), (2, [(0, 0, x) for x in (3, 4, 5)]))
    o = {x.label: x for x in interaction.overlap_per_primary(p, r, "R").collect()}
    assert (o[1].overlap_vol_um3_R, o[1].dominant_overlap_id_R, o[1].overlap_fraction_of_partner_R, o[2].overlap_fraction_R, o[2].dominant_overlap_id_R, o[2].overlap_fraction_of_partner_R) == (5, 2, 1.0, 0.5, 1, 0.5)
    assert abs(o[1].overlap_fraction_R - 5 / 6) < 1e-12
    c = {x.ref_label: x for x in interaction.coverage(p, r).collect()}
    assert (c[1].total_overlap_vol_um3, c[1].interacting_labels, c[1].percent_covered) == (4, [1, 2], 100) and (c[2].interacting_cell_count, c[2].interacting_labels) == (1, [1])
    d = {x.label: x for x in interaction.distance_to_reference(p, r, "R").collect()}
    assert (d[1].dist_to_nearest_R_um, d[1].nearest_R_id) == (0.0, 1)
    none = interaction.distance_to_reference(p, r.limit(0), "R").where("label = 1").first()
    assert (none.dist_to_nearest_R_um, none.nearest_R_id) == (None, 0)


def test_stitching_and_merging(spark):
    left = voxels(spark, (1, [(0, 0, 0)]), (2, [(0, 0, 1)]), (3, [(0, 0, 2)]))
    right = voxels(spark, (11, [(0, 0, 0)]), (12, [(0, 0, 1)]), (13, [(0, 0, 2)]))
    seeds = spark.createDataFrame([(1, [1]), (11, [2]), (2, [1]), (12, [1, 3]), (13, [2])], "label int, seeds array<int>")
    assert {(r.a, r.b): r.merge for r in interaction.stitch_pairs(left, right, seeds).collect()} == {(1, 11): False, (2, 12): True, (3, 13): True}
    e = spark.createDataFrame([(1, 2), (2, 4), (7, 7), (None, 3)], "a int, b int")
    assert {r.node: r.component for r in connected_components(e).collect()} == {1: 1, 2: 1, 4: 1}


def test_statistics(spark):
    rows = [(g, float(v)) for g, vs in (("a", (1, 2, 3, 4)), ("b", (2, 4, 6, 8)), ("c", (5, 6, 7, 8)), (None, (1, 2))) for v in vs]
    df = spark.createDataFrame(rows, "g string, m double")
    t = cohort.welch(df, ["m"], "g", ["a", "b"]).first()
    assert abs(t.statistic + 1.732051) < 1e-6 and abs(t.df - 4.411765) < 1e-6 and abs(stats.t_two_sided(t.statistic, t.df) - 0.151581) < 1e-6
    f = cohort.anova(df, ["m"], "g").first()
    assert abs(f.statistic - 4.9) < 1e-9 and abs(stats.f_upper(f.statistic, 2, 9) - 0.036340) < 1e-6
    assert abs(cohort.run_tests(df, ["m"], "g", "x", ["a", "b"]).first().P_Value - 0.151581) < 1e-6
    p = spark.createDataFrame([(0.01,), (0.04,), (0.5,), (None,)], "P_Value double")
    got = [(r.P_Value_Corrected, r.Significant_After_Correction) for r in cohort.bonferroni(p).orderBy("P_Value").collect()]
    assert got[1:] == [(0.03, True), (0.12, False), (1.0, False)] and got[0] == (None, False)
    q = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9)], "v double").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.99)))).first()[0]
    assert np.allclose(q, [1.75, 3.0, 8.85])


def test_names(spark):
    df = spark.createDataFrame([("Image_10", "iba1-5th_2", "S1.czi #2"), ("Image_2", "zz", "A.tiff")], "a string, b string, c string")
    rows = df.orderBy(fx.natural_key(F.col("a"))).select("a", fx.ordinal_group(F.col("b")), fx.clean_name(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("Image_2", "2D_Other", "a"), ("Image_10", "5th", "s1")]
    one = spark.range(1)
    assert one.select(fx.axis_label(F.lit("skan_total_length_um"))).first()[0] == "Skan Total Length µm"
    xml = F.lit('<S><Distance Id="X"><Value>2.5e-07</Value></Distance><Distance Id="Z"><Value>1e-06</Value></Distance></S>')
    assert {k: round(v, 6) for k, v in one.select(fx.czi_scaling(xml)).first()[0].items()} == {"X": 0.25, "Z": 1.0}
    v = spark.createDataFrame([(1.0,), (math.inf,), (math.nan,), (None,)], "v double")
    assert [r[0] for r in v.select(fx.finite_or_zero(F.col("v"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_resume_and_groups(spark):
    c = spark.createDataFrame([("i", s, s != 3) for s in (1, 2, 3, 4)] + [("j", s, True) for s in range(1, 7)], "image_id string, step int, present boolean")
    assert {r.image_id: r.last_completed for r in cohort.resume_point(c, 6).collect()} == {"i": 2, "j": 6}
    wide = spark.createDataFrame([("b1", "im1", " im2"), ("b2", "im3", None)], "batch string, G1 string, G2 string")
    assert sorted(tuple(r) for r in cohort.unpivot_groups(wide, "batch").collect()) == [("b1", "G1", "im1"), ("b1", "G2", "im2"), ("b2", "G1", "im3")]
    cells = spark.createDataFrame([("im1", 1.0)], "Image_ID string, m double")
    assert cohort.attach_groups(cells, cohort.unpivot_groups(wide, "batch").limit(0), tag="t").first().Experimental_Group == "t_DefaultGroup"


def test_distance_transform_against_brute_force(spark):
    r = np.random.default_rng(2)
    at = np.argwhere(np.ones((4, 9, 11)))
    feature = r.random(len(at)) < 0.05
    s = (2.0, 1.0, 0.5)
    df = spark.createDataFrame([(*map(int, p), bool(f)) for p, f in zip(at, feature, strict=True)], "z int, y int, x int, f boolean")
    got = {(v.z, v.y, v.x): v.distance for v in raster.distance_transform(df, df.where("f"), s, dims=3, lines=3).collect()}
    sites = at[feature] * s
    want = {tuple(map(int, p)): float(np.sqrt((((p * s) - sites) ** 2).sum(axis=1)).min()) for p in at}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {v.distance for v in raster.distance_transform(df, df.limit(0), s, dims=3).collect()} == {None}
    mask = ~feature.reshape(4, 9, 11)
    outside = np.argwhere(np.pad(~mask, 1, constant_values=True)) - 1
    dense = kernels.edt(mask, s)
    assert all(abs(dense[tuple(p)] - np.sqrt((((p - outside) * s) ** 2).sum(axis=1)).min()) < 1e-9 for p in np.argwhere(mask))


def test_components_against_dense_labels(spark):
    r = np.random.default_rng(5)
    for dims, shape, full in ((2, (1, 40, 37), False), (3, (6, 14, 15), True), (3, (6, 14, 15), False)):
        mask = r.random(shape) < 0.4
        at = np.argwhere(mask)
        ids = np.ravel_multi_index(at.T, shape)
        df = spark.createDataFrame([(*map(int, p), int(i)) for p, i in zip(at, ids, strict=True)], "z int, y int, x int, id long")
        want, _ = kernels.label_components(mask, full)
        first = {}
        for p, i in zip(at, ids, strict=True):
            first.setdefault(int(want[tuple(p)]), int(i))
        for tile in (4, 128):
            got = {v.id: v.label for v in raster.components(df, full=full, dims=dims, tile=tile).collect()}
            assert got == {int(i): first[int(want[tuple(p)])] for p, i in zip(at, ids, strict=True)}


def test_betti(spark):
    from cellplan.plans import raster_queries

    d = "/root/testdata/sf0.001"
    r = raster_queries.QUERIES["betti_numbers"](spark, d).first()
    mask = np.zeros((1, 10, 100), bool)
    from cellplan.plans.views import fg

    for v in fg(spark, d).collect():
        mask[0, v.y, v.x] = True
    assert (r.b0, r.background) == (kernels.label_components(mask, True)[1], kernels.label_components(~mask, False)[1])
