"""Kernels by their properties, and the pipeline from voxels to measurements."""

import time

import numpy as np
from pyspark.sql import functions as F

from cellplan.operators import kernels, seeds
from cellplan.plans import segmentation
from cellplan.sources import arrays
from cellplan.sources.config import Config


def disc(shape, centre, radius):
    y, x = np.indices(shape)
    return (y - centre[0]) ** 2 + (x - centre[1]) ** 2 <= radius**2


def test_watershed_splits_touching_discs():
    mask = (disc((40, 60), (20, 18), 12) | disc((40, 60), (20, 40), 12))[None]
    markers = np.zeros(mask.shape, np.int64)
    markers[0, 20, 18], markers[0, 20, 40] = 1, 2
    out = kernels.watershed(kernels.landscape(mask, np.ones(mask.shape), 0.0), markers, mask)
    assert ((out > 0) == mask).all() and out[0, 20, 8] == 1 and out[0, 20, 50] == 2 and abs(int((out == 1).sum()) - int((out == 2).sum())) < 30


def test_thinning_keeps_topology():
    ring = (disc((40, 40), (20, 20), 15) & ~disc((40, 40), (20, 20), 7))[None]
    skel = kernels.skeleton(ring)
    assert skel.sum() < ring.sum() / 4 and kernels.label_components(skel, True)[1] == 1 and kernels.label_components(~skel, False)[1] == 2
    opened = kernels.break_cycles(skel, kernels.edt(ring))
    assert kernels.label_components(~opened, False)[1] == 1 and kernels.label_components(opened, True)[1] == 1
    bar = np.zeros((7, 9, 20), bool)
    bar[2:5, 3:6, 2:18] = True
    thin = kernels.skeleton(bar)
    assert thin.sum() < 25 and kernels.label_components(thin, True)[1] == 1


def test_cycles_in_3d():
    """Loops are opened at their thinnest place, and what remains is a forest of as many parts."""
    ring = np.zeros((9, 30, 52), bool)
    for x in (15, 36):
        ring[3:6] |= (disc((30, 52), (15, x), 13) & ~disc((30, 52), (15, x), 8))[None]
    ring[4, 2:6, 14:17] = False  # leaves the first ring thin there
    skel = kernels.skeleton(ring)
    assert kernels.cycle_basis(skel)
    opened = kernels.open_cycles(skel, (1.0, 1.0, 1.0), kernels.edt(ring))
    assert not kernels.cycle_basis(opened) and opened.sum() > 0.5 * skel.sum() and not (opened & ~skel).any()
    line = np.zeros((3, 3, 9), bool)
    line[1, 1] = True
    assert kernels.cycle_basis(line) == [] and (kernels.open_cycles(line, (1.0, 1.0, 1.0), kernels.edt(line)) == line).all()
    square = np.zeros((1, 5, 5), bool)
    square[0, 1:4, 1:4] = True
    square[0, 2, 2] = False
    n, e = int(square.sum()), int(kernels.degrees(square).sum()) // 2
    assert len(kernels.cycle_basis(square)) == e - n + 1


def test_spurs_and_branches():
    line = np.zeros((1, 21, 41), bool)
    line[0, 10, 2:39] = True
    line[0, 8:10, 20] = True
    pruned = kernels.prune_elbows(kernels.prune_spurs(line, (1.0, 1.0, 1.0), 4.0))
    assert not pruned[0, 8:10, 20].any() and pruned[0, 10, 2:39].all()
    paths = kernels.branches(pruned, (1.0, 1.0, 1.0))
    assert len(paths) == 1 and paths[0]["length"] == 36
    assert (kernels.prune_spurs(line, (1.0, 1.0, 1.0), 0.5) == line).all()
    edges = [{"u": a, "v": b, "thickness": t} for a, b, t in ((1, 2, 5), (2, 3, 1), (1, 3, 4))]
    assert [e["thickness"] for e in kernels.spanning_tree(edges)] == [5, 4]


def test_ridges():
    a = np.zeros((1, 40, 40))
    a[0, 20, 5:35] = 10
    for f in (kernels.frangi, kernels.sato):
        r = f(a, 2.0)
        assert r[0, 20, 20] > 5 * r[0, 10, 20] and r.min() >= 0


def test_seed_order():
    assert [s[2] for s in seeds.strategies((0.6,), (90, 50))] == [2.09, 2.05, 0.6006]
    mask = (disc((40, 70), (20, 18), 12) | disc((40, 70), (20, 50), 12))[None]
    found = seeds.candidates(mask, np.ones(mask.shape), least_fragment=10, most_thick=50)
    assert found and all(n >= 10 for _, n, _ in found)


def test_placement_by_groups(spark):
    """Seeds are those that one greedy pass over all candidates of an image would place, numbered in its order."""
    r = np.random.default_rng(2)
    pixels = {}
    for label in range(1, 40):
        y, x = r.integers(5, 120, 2)
        for p in zip(*np.nonzero(disc((130, 130), (y, x), int(r.integers(3, 7)))), strict=True):
            pixels.setdefault(tuple(map(int, p)), label)
    rows = [(label, 0, y, x, float(r.random())) for (y, x), label in pixels.items()]
    cells = spark.createDataFrame(rows, "label int, z int, y int, x int, intensity double")
    options = {"least_fragment": 3, "least_thickness": 0.5, "ratios": (0.5, 0.7), "percentiles": (60,)}
    for separation, within in ((9.0, False), (9.0, True), (0.0, False)):
        wanted, centres = [], []
        every = []
        for label in sorted(set(pixels.values())):
            at = np.array([p for p, q in pixels.items() if q == label])
            low = at.min(axis=0)
            grid, val = np.zeros((1, *(at.max(axis=0) - low + 1))), np.zeros((1, *(at.max(axis=0) - low + 1)))
            for (one, _, y, x, v) in rows:
                if one == label:
                    grid[0, y - low[0], x - low[1]], val[0, y - low[0], x - low[1]] = 1, v
            found = seeds.candidates(grid > 0, val, (1.0, 1.0, 1.0), (0.5, 0.7), (60,), 3, 0.5, 10.0, 10.0, 0, 0.0)
            every += [(-s, -n, label, (at_ + [0, *low]).ravel().tolist()) for s, n, at_ in found]
        used = set()
        for _, _, label, at_ in sorted(every):
            voxels = set(map(tuple, np.array(at_).reshape(-1, 3).tolist()))
            centre = np.mean(sorted(voxels), axis=0)
            if used & voxels or any((within or one != label) and np.linalg.norm(centre - c) < separation for one, c in centres):
                continue
            used |= voxels
            centres.append((label, centre))
            wanted += [(label, len(centres), *v) for v in voxels]
        got = seeds.extract_seeds(cells, separation_um=separation, apart_within=within, **options)
        assert sorted(map(tuple, got.collect())) == sorted(wanted) and wanted
        two = cells.withColumn("image_id", seeds.F.explode(seeds.F.array(seeds.F.lit("a"), seeds.F.lit("b"))))
        assert sorted(tuple(x)[1:] for x in seeds.extract_seeds(two, separation_um=separation, apart_within=within, **options).where("image_id = 'b'").collect()) == sorted(wanted)


def image():
    r = np.random.default_rng(0)
    a = 1 + 0.2 * r.random((96, 128))
    for y, x, rad in ((25, 25, 9), (25, 90, 10), (70, 30, 8), (65, 82, 10), (65, 101, 10)):
        a[disc(a.shape, (y, x), rad)] += 8
    return a


def test_pipeline_and_resume(spark, tmp_path):
    a = image()
    voxels = spark.createDataFrame([(0, int(y), int(x), float(a[y, x])) for y, x in np.ndindex(a.shape)], "z long, y long, x long, intensity double").cache()
    c = Config.default("2d")
    c.steps["raw_segmentation"] |= {"tubular_scales": [0.0], "min_size": 50, "low_threshold_percentile": 88.0}
    c.steps["extract_seeds"] |= {"min_fragment_size": 12, "min_physical_peak_separation": 5.0, "absolute_max_thickness_um": 30.0, "seeding_min_distance_um": 0.0, "ratios_to_process": [0.6], "intensity_percentiles_to_process": []}
    c.steps["separate_cells"] |= {"min_path_intensity_ratio": 5.0, "min_local_intensity_difference": 0.0}
    run = segmentation.Run(spark, str(tmp_path), c, (1.0, 1.0, 1.0))
    reference = spark.createDataFrame([(0, y, x, 1) for y in range(20, 30) for x in range(20, 30)], "z long, y long, x long, label long")
    status = run.execute(voxels, reference, "vessel")
    assert [s for _, s in status] == ["done"] * 6, status
    assert run.artifact("raw_segmentation").select("label").distinct().count() == 4
    cells = run.artifact("separate_cells")
    assert sorted(r.label for r in cells.select("label").distinct().collect()) == [1, 2, 3, 4, 5]
    t = run.artifact("calculate_features")
    assert t.count() == 5 and t.where("circularity < 0.6 or solidity < 0.8 or shortest_distance_um is null").count() == 0
    i = run.artifact("interaction")
    assert i.where("overlaps_any_vessel").count() == 1 and i.where("dist_to_nearest_vessel_um > 0").count() == 4
    assert [s for _, s in run.execute(voxels, reference)] == ["kept"] * 6 and run.last_completed() == 6
    run.discard_from(5)
    assert run.last_completed() == 4 and [s for _, s in run.execute(voxels)] == ["kept"] * 4 + ["done", "skipped"]


def test_files(spark, tmp_path):
    stack = (np.random.default_rng(1).random((3, 5, 7)) * 100).astype("uint16")
    (tmp_path / "a.tif").write_bytes(arrays.encode_tiff(stack, 0.25))
    got = np.zeros_like(stack)
    for v in arrays.read_tiff(spark, f"{tmp_path}/a.tif").collect():
        got[v.z, v.y, v.x] = v.intensity
        assert v.image_id == "a"
    assert (got == stack).all()
    m = arrays.tiff_metadata(spark, f"{tmp_path}/a.tif").first()
    assert (m.pages, m.height, m.width, m.unit_code) == (3, 5, 7, 3) and abs(10_000 / m.density - 0.25) < 1e-9
    labels = np.random.default_rng(1).integers(0, 4, (3, 5, 7)).astype("int32")
    labels.tofile(tmp_path / "m.dat")
    df = arrays.read_raw(spark, f"{tmp_path}/m.dat", labels.shape)
    assert df.count() == (labels > 0).sum()
    assert b"".join(bytes(r.data) for r in arrays.to_raw(df, labels.shape).orderBy("z").collect()) == labels.tobytes()
    spark.dataSource.register(arrays.RawArraySource)
    again = spark.read.format("rawarray").options(path=f"{tmp_path}/m.dat", shape="3,5,7").load()
    assert again.exceptAll(df.select("z", "y", "x", "label")).count() == 0 and again.count() == df.count()
    out = arrays.numeric_export(df.withColumn("t", F.lit("x")).withColumn("v", F.lit(float("inf"))))
    assert out.columns == ["label", "z", "y", "x", "v"] and out.first().v == 0.0


def test_config():
    c = Config.from_yaml("mode: 2d\npixel_dimensions: {y: 96, x: 256}\nraw_segmentation:\n  parameters:\n    min_size: {value: 7}\nsaved_state: {segmentation_threshold: 1.5}\n")
    assert c.value("raw_segmentation", "min_size") == 7 and c.value("raw_segmentation", "smooth_sigma") == 0.3
    assert c.spacing((1, 96, 128)) == (1.0, 1.0, 2.0) and Config.from_yaml(c.to_yaml()) == c


def test_stream(spark, tmp_path):
    from cellplan.streaming import folders

    rows = [("i", 0, 0, y, x, float(x)) for y in range(4) for x in range(5)]
    spark.createDataFrame(rows, "image_id string, channel int, z int, y int, x int, intensity double").repartition(3).write.parquet(f"{tmp_path}/in")
    seen = []
    for _ in range(2):
        q = folders.process_arrivals(folders.voxel_stream(spark, f"{tmp_path}/in", files_per_batch=1), lambda df, n: seen.append(df.count()), f"{tmp_path}/ck")
        q.awaitTermination()
    assert sum(seen) == 20
    q = folders.measured(folders.voxel_stream(spark, f"{tmp_path}/in"), 1.5).writeStream.format("memory").queryName("m").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("m").first().voxels == 12


def test_orphans_and_voids(spark):
    from cellplan.operators import interaction, raster

    # One cell: label 1 with its seed, a part of label 1 without one beside label 2, a far part without neighbours.
    rows = [(1, 0, 0, x, 1, 7 if x == 1 else None) for x in range(4)] + [(1, 0, 0, x, 2, 8 if x == 6 else None) for x in range(4, 8)]
    rows += [(1, 0, 1, x, 1, None) for x in (6, 7)] + [(1, 0, 5, x, 1, None) for x in (0, 1)] + [(2, 0, 9, 9, 3, None)]
    df = raster.numbered(spark.createDataFrame(rows, "cell int, z int, y int, x int, label long, seed int"))
    got = {(r.y, r.x): r.label for r in interaction.settle_orphans(df).collect()}
    assert got == {(y, x): 2 if (y, x) in ((1, 6), (1, 7)) else n for _, _, y, x, n, _ in rows}
    assert (5, 0) not in {(r.y, r.x) for r in interaction.settle_orphans(df, 3).collect()} and (9, 9) in {(r.y, r.x) for r in interaction.settle_orphans(df, 3).collect()}
    # A shell of label 1 around a void, a void between two labels, an open one.
    cube = np.zeros((5, 5, 16), int)
    cube[:, :, :5], cube[:, :, 6:9], cube[:, :, 9:11] = 1, 2, 3
    cube[2, 2, 2] = cube[2, 2, 8] = cube[2, 2, 9] = cube[0, 1, 1] = 0
    at = [(int(z), int(y), int(x), int(v)) for (z, y, x), v in np.ndenumerate(cube)]
    labels = spark.createDataFrame([r for r in at if r[3]], "z int, y int, x int, label long")
    domain = raster.numbered(spark.createDataFrame([r[:3] for r in at], "z int, y int, x int"))
    filled = {(r.z, r.y, r.x): r.label for r in interaction.fill_voids(labels, domain).collect()}
    assert filled == {r[:3]: r[3] for r in at if r[3]} | {(2, 2, 2): 1}


def test_narrowed_percentiles(spark):
    from cellplan.operators import levels

    r = np.random.default_rng(6)
    for values in (r.standard_normal(3000), r.integers(0, 7, 3000).astype(float), np.r_[r.random(500) * 1e-12, 1e9, -1e9], np.full(50, 3.25), np.array([5.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        for p in (0, 37.5, 60, 99.9, 100):
            assert np.isclose(levels.narrowed(df, p, bins=16, few=20), np.percentile(values, p), rtol=1e-12, atol=0)
            assert np.isclose(levels.level(df, "v", p, most=0).first()[0], levels.level(df, "v", p).first()[0], rtol=1e-12, atol=0)
    odd = spark.createDataFrame([(float(v),) for v in [1, 2, float("inf"), float("-inf"), float("nan")]], "v double")
    assert levels.narrowed(odd, 50) == 2.0 and levels.narrowed(odd, 0) == float("-inf") and levels.narrowed(odd, 75) == float("inf") and np.isnan(levels.narrowed(odd, 100))
    assert levels.level(odd.where("v > 5 and v < 6"), "v", 50, most=0).first()[0] is None


def test_cut_vertices():
    """Voxels whose loss parts their component, against counting the components without each."""
    rng = np.random.default_rng(5)
    for _ in range(10):
        mask = rng.random((1, 9, 9)) < 0.4
        at = [tuple(map(int, p)) for p in np.argwhere(mask)]
        near = [[k for k, q in enumerate(at) if q != p and max(abs(a - b) for a, b in zip(p, q, strict=True)) == 1] for p in at]
        whole = kernels.label_components(mask, True)[1]
        for p, cut in zip(at, kernels.cut_vertices(near), strict=True):
            rest = mask.copy()
            rest[p] = False
            assert cut == (kernels.label_components(rest, True)[1] > whole)


def test_large_skeletons_take_time_in_proportion():
    """A spine with 998 teeth: each went with two counts of all components."""
    comb = np.zeros((1, 7, 4003), bool)
    comb[0, 5, 1:4002] = True
    comb[0, 4, 8:4000:4] = True  # junctions, which stay
    spine = comb.copy()
    comb[0, 3, 8:4000:4] = True
    began = time.process_time()
    out = kernels.prune_spurs(comb, (1.0, 1.0, 1.0), 2.5)
    assert (out == spine).all() and time.process_time() - began < 30
    ring = np.zeros((1, 402, 402), bool)
    ring[0, 1::8, 1:394] = ring[0, 1:394, 1::8] = True
    opened = kernels.break_cycles(ring, np.ones(ring.shape))
    assert ring.sum() - opened.sum() == 15 and time.process_time() - began < 60


def test_all_loops_are_opened(spark):
    """A grid of 36 loops (15 were opened), against a search for each loss; and what the other steps left after so many passes."""
    rng = np.random.default_rng(3)
    grid = np.zeros((1, 29, 29), bool)
    grid[0, 1:27:4, 1:26] = grid[0, 1:26, 1:27:4] = True
    for mask in (grid, *(rng.random((1, 16, 16)) < p for p in (0.3, 0.5, 0.7, 0.9))):
        thick = kernels.edt(mask)
        opened, found = kernels.break_cycles(mask, thick, None), kernels._break_by_search(mask, thick, None)
        assert (opened == found).all() and (kernels.break_cycles(mask, thick) == kernels._break_by_search(mask, thick, 15)).all()
        assert kernels.label_components(opened, True)[1] == kernels.label_components(mask, True)[1]
    assert kernels.cycle_basis(kernels.break_cycles(grid, np.ones(grid.shape), None)) == []
    rows = [(1, 0, int(y), int(x)) for _, y, x in np.argwhere(grid)]
    got = kernels.skeletonize(spark.createDataFrame(rows, "label long, z long, y long, x long")).select("y", "x").collect()
    out = np.zeros(grid.shape, bool)
    for r in got:
        out[0, r.y, r.x] = True
    assert kernels.cycle_basis(out) == [] and kernels.label_components(out, True)[1] == 1


def test_opening_loops_takes_time_in_proportion():
    """Thousands of loops in one object, without a search of the object for each."""
    ring = np.zeros((1, 402, 402), bool)
    ring[0, 1::8, 1:394] = ring[0, 1:394, 1::8] = True
    began = time.process_time()
    opened = kernels.break_cycles(ring, np.ones(ring.shape), None)
    assert time.process_time() - began < 20 and kernels.cycle_basis(opened) == []
    assert kernels.label_components(opened, True)[1] == kernels.label_components(ring, True)[1]
