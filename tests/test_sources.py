"""Loading of cohorts and project plans."""

from pyspark.sql import functions as F

from cellplan.functions import columns
from cellplan.functions.columns import ordinal_group
from cellplan.sources import cohort, project, sinks


def test_load_dataset(spark, tmp_path):
    for image, rows in (("iba1-5th_1", ["1,2.5", "2,3.5"]), ("zz", ["1,4.0"]), ("empty", [])):
        folder = tmp_path / image / "out_processed_2d"
        folder.mkdir(parents=True)
        (folder / "metrics.csv").write_text("\n".join(["label,area", *rows]) + "\n")
    groups = spark.createDataFrame([("zz", "G", "b1")], "Image_ID string, Experimental_Group string, Batch string")
    got = cohort.load_dataset(spark, "2D", f"{tmp_path}/*/*/metrics.csv", "label int, area double", groups=groups, derive=ordinal_group)
    assert sorted((r.Image_ID_Full, r.label, r.Experimental_Group, r.Batch, r.Dataset_Tag) for r in got.collect()) == [("iba1-5th_1", 1, "5th", "iba1-5th_1", "2D"), ("iba1-5th_1", 2, "5th", "iba1-5th_1", "2D"), ("zz", 1, "G", "b1", "2D")]
    only = cohort.load_dataset(spark, "2D", f"{tmp_path}/*/*/metrics.csv", "label int, area double", keep=lambda p: p.contains("zz"))
    assert only.count() == 1 and only.first().Experimental_Group == "2D_DefaultGroup"
    assert cohort.load_cohort(got, only.drop("area")).count() == 4


def test_project(spark, tmp_path):
    for f in ("a/x.tif", "a/x.yaml", "b/y.tif", "c/z.tif", "c/z.yaml", "c/w.tiff"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_text("mode: 2d\npixel_dimensions: {x: 1}\n")
    files = project.listing(spark, str(tmp_path))
    assert [r.folder.rsplit("/", 1)[1] for r in project.valid_folders(files).collect()] == ["a"]
    meta = spark.createDataFrame([("X.TIF", 1.0), ("nothing", 2.0), ("y.czi #1", 3.0)], "Filename string, w double")
    plan = {r.Filename: r.path.rsplit("/", 2)[1] for r in project.organise(meta, files.where(F.col("path").rlike(r"tiff?$"))).collect()}
    assert plan == {"X.TIF": "a", "y.czi #1": "b"}
    configs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yaml").load(str(tmp_path))
    assert cohort.with_dimension_key(configs, "pixel_dimensions").count() == 2 and cohort.with_dimension_key(configs, "voxel_dimensions").count() == 0
    f = spark.createDataFrame([("/d/p.tif", 1, 3, 4, 5, 2.0, 0.5, 0.25), ("/d/q.tif", 2, 1, 2, 2, 1.0, 1.0, 1.0)], "path string, n_channels int, nz int, ny int, nx int, sz double, sy double, sx double")
    got = sorted((r.channel, r.Filename, r["Width (um)"], r["Depth (um)"]) for r in cohort.channel_plan(f, 2).collect())
    assert got == [(0, "p.tif", 1.25, 6.0), (0, "q.tif", 2.0, 1.0), (1, "q.tif", 2.0, 1.0)]
    refs = spark.createDataFrame([("i", "final_segmentation_b", "/r/b"), ("i", "final_segmentation_a", "/r/a"), ("i", "metrics", "/r/0")], "image_id string, artifact string, path string")
    assert {r.image_id: r.reference_path for r in project.interaction_reference(spark.createDataFrame([("i",), ("j",)], "image_id string"), refs).collect()} == {"i": "/r/a", "j": None}


def test_number_format(spark):
    import random

    r = random.Random(3)
    values = [0.0, -0.0, 1.0, 100000.0, 99999.6, 0.0001, 0.00001234567, 123456.0, -2.5e-7, 1e22, 3.0e-300, float("inf"), float("-inf"), 0.1, 12.5, *(r.choice([-1, 1]) * r.random() * 10 ** r.randrange(-9, 12) for _ in range(400))]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for digits in (3, 5):
        got = [r[0] for r in df.select(sinks.general_format(F.col("v"), digits)).collect()]
        want = [f"{v:.{digits}g}".replace("-0", "0") if v == 0 else f"{v:.{digits}g}" for v in values]
        assert got == want, [(g, w) for g, w in zip(got, want, strict=True) if g != w][:5]
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS v").select(sinks.general_format(F.col("v"), 5)).first()[0] == ""


def test_csv_and_fcs(spark, tmp_path):
    df = spark.createDataFrame([("i", 2, 1.23456789, None, "t"), ("i", 1, float("inf"), 7, "u"), ("j", 5, 2.0, 3, "v")], "image_id string, label int, area double, n int, name string")
    sinks.write_csv(df, f"{tmp_path}/csv", 5)
    got = sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()))
    assert got == [("i", "1", "inf", "7", "u"), ("i", "2", "1.2346", None, "t"), ("j", "5", "2", "3", "v")]
    files = sinks.fcs_files(df).withColumn("path", F.concat(F.lit(f"{tmp_path}/fcs/"), "image_id", F.lit(".fcs")))
    assert sinks.write_files(files) == 2
    names, rows = sinks.decode_fcs((tmp_path / "fcs" / "i.fcs").read_bytes())
    assert names == ["label", "area", "n"] and rows[:, 0].tolist() == [1.0, 2.0] and rows[0, 1] == 0.0 and abs(rows[1, 1] - 1.23456789) < 1e-6 and rows[:, 2].tolist() == [7.0, 0.0]


def test_project_on_disk(spark, tmp_path):
    for f in ("x.tif", "y.tif"):
        (tmp_path / f).write_text("t")
    plan = spark.createDataFrame([(f"{tmp_path}/x.tif", f"{tmp_path}/x"), (f"{tmp_path}/gone.tif", f"{tmp_path}/gone")], "path string, folder string")
    assert len(sinks.move_files(plan)) == 1 and (tmp_path / "x" / "x.tif").read_text() == "t" and sinks.move_files(plan) == []
    sinks.write_image_config(spark, f"{tmp_path}/x/x.yaml", "2d", {"x": 12.5, "y": 8.0})
    sinks.write_interaction_metadata(spark, f"{tmp_path}/i.yaml", "p", "r", "m", "c")
    assert [r.folder.rsplit("/", 1)[1] for r in project.valid_folders(project.listing(spark, f"{tmp_path}/x")).collect()] == ["x"]
    assert [r.title for r in sinks.presets(project.listing(spark, str(tmp_path))).collect()] == ["I", "X"]
    import yaml

    assert yaml.safe_load((tmp_path / "x" / "x.yaml").read_text()) == {"mode": "2d", "pixel_dimensions": {"x": 12.5, "y": 8.0}}
    assert list(yaml.safe_load((tmp_path / "i.yaml").read_text()).values()) == ["p", "r", "m", "c"]


def test_channel_count(spark):
    rows = [("ImageJ=1.53\nimages=6\nchannels=3\nslices=2", [6, 9, 9], 3), ("ImageJ=1.53\nimages=6", [3, 9, 9], 1), ('<OME><Pixels SizeC="4"/></OME>', [2, 9, 9], 4), ("x", [2, 9, 9], 2), (None, [12, 9, 9], 1), (None, [3, 2, 9, 9], 2), ("", [9, 9], 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "d string, s array<int>, n int")
    assert [(r.n, r.got) for r in df.select("n", columns.channel_count(F.col("d"), F.col("s")).alias("got")).collect()] == [(n, n) for *_, n in rows]
