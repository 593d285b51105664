"""Queries of cohort statistics and of scalar functions: a line item is a cell, an order an image, a nation a replicate,
a market segment an experimental group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import cohort
from .views import r6

METRICS = ["l_quantity", "l_extendedprice", "l_discount"]
CELLS = """cells AS (SELECT l.*, o_orderkey AS image, CAST(c_nationkey AS VARCHAR) AS batch, c_mktsegment AS grp FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
REPLICATES = f"""{CELLS}, im AS (SELECT image, batch, grp, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice, avg(l_discount) AS l_discount, count(*) AS n FROM cells GROUP BY 1, 2, 3),
rep AS (SELECT batch, grp, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice, avg(l_discount) AS l_discount, avg(n) AS cells FROM im GROUP BY 1, 2)"""


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def cells(s, d):
    o, c = _t(s, d, "orders"), _t(s, d, "customer")
    return _t(s, d, "lineitem").join(o, F.col("l_orderkey") == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select("l_orderkey", *METRICS, "l_tax", "l_returnflag", F.col("o_orderkey").alias("image"), F.col("c_nationkey").cast("string").alias("batch"), F.col("c_mktsegment").alias("grp"))


def _rep(s, d):
    return cohort.two_level_mean(cells(s, d), METRICS, "image", "batch", "grp")


def _cohort_load(s, d):
    """Orders as cells, customers as the external assignment."""
    images = _t(s, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("Image_ID"), F.col("o_orderpriority").alias("Experimental_Group"))
    groups = _t(s, d, "customer").select(F.col("c_custkey").cast("string").alias("Image_ID"), F.col("c_mktsegment").alias("Experimental_Group"), F.col("c_nationkey").alias("Batch"))
    return cohort.attach_groups(images, groups).select("o_orderkey", "Experimental_Group", "Batch")


def _unpivot(s, d):
    n = _t(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("Batch"), F.when(F.col("n_regionkey") != 2, F.concat(F.lit(" "), "n_name")).alias("Group1"), F.concat(F.lit("im"), F.col("n_regionkey").cast("string"), F.lit(" ")).alias("Group2"))
    return cohort.unpivot_groups(n, "Batch", {"Group1": "Control"})


def _welch(s, d):
    return cohort.welch(_rep(s, d), METRICS, "grp").select("metric", "group_a", "group_b", *r6("statistic", "df"))


def _anova(s, d):
    return cohort.anova(_rep(s, d), METRICS, "grp").select("metric", "groups", *r6("statistic"), "df_between", "df_within")


WELCH = f"""WITH {REPLICATES}, l AS (UNPIVOT (SELECT grp, l_quantity, l_extendedprice, l_discount FROM rep) ON l_quantity, l_extendedprice, l_discount INTO NAME metric VALUE v), m AS (SELECT metric, grp, count(*) AS n, avg(v) AS m, var_samp(v) AS q FROM l GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a.metric, a.grp AS group_a, b.grp AS group_b, round((a.m - b.m) / sqrt(a.q / a.n + b.q / b.n), 6) AS statistic, round(pow(a.q / a.n + b.q / b.n, 2) / (pow(a.q / a.n, 2) / (a.n - 1) + pow(b.q / b.n, 2) / (b.n - 1)), 6) AS df FROM m a JOIN m b ON a.metric = b.metric AND a.grp < b.grp"""
ANOVA = f"""WITH {REPLICATES}, l AS (UNPIVOT (SELECT grp, l_quantity, l_extendedprice, l_discount FROM rep) ON l_quantity, l_extendedprice, l_discount INTO NAME metric VALUE v), m AS (SELECT metric, grp, count(*) AS n, avg(v) AS m, var_samp(v) AS q FROM l GROUP BY 1, 2), g AS (SELECT metric, avg(v) AS g FROM l GROUP BY 1),
t AS (SELECT metric, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * (m - g) * (m - g)) AS sb, sum((n - 1) * q) AS sw FROM m JOIN g USING (metric) GROUP BY 1) SELECT metric, k AS groups, round((sb / (k - 1)) / (sw / (n - k)), 6) AS statistic, k - 1 AS df_between, n - k AS df_within FROM t"""


def _bonferroni(s, d):
    """Pseudo p-values from part sizes, one family per brand."""
    p = _t(s, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n")).select("p_brand", "p_size", F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 2000.0).alias("p"))
    return cohort.bonferroni(p, "p", ("p_brand",)).select("p_brand", "p_size", *r6("p", "P_Value_Corrected"), "Significant_After_Correction")



def _natural(s, d):
    """Each size class's names in natural order: first and last."""
    n = _t(s, d, "part").select("p_size", F.concat(F.lit("Image_"), F.col("p_partkey").cast("string"), F.lit(".tif")).alias("name"))
    return n.groupBy("p_size").agg(F.min_by("name", fx.natural_key(F.col("name"))).alias("first"), F.max_by("name", fx.natural_key(F.col("name"))).alias("last"))


def _regex_groups(s, d):
    name = F.concat(F.when(F.col("p_size") % 3 == 0, "iba1-").otherwise("neun-"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "th_").otherwise("x_"), F.col("p_partkey").cast("string"))
    return _t(s, d, "part").select(fx.ordinal_group(name).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


def _labels(s, d):
    t = F.lower(F.regexp_replace("p_type", " ", "_"))
    return _t(s, d, "part").select(F.concat(t, F.when(F.col("p_size") % 3 == 0, "_um").when(F.col("p_size") % 3 == 1, "_um2").otherwise("_um3")).alias("metric")).distinct().select("metric", fx.axis_label(F.col("metric")).alias("label"))


def _stars(s, d):
    p = (F.col("p_size") / 600.0).alias("p")
    return _t(s, d, "part").select("p_size", p).distinct().select("p_size", fx.significance(F.col("p")).alias("stars"), fx.p_text(F.col("p")).alias("text"))


def _fuzzy(s, d):
    wanted = _t(s, d, "supplier").select(F.concat(F.lit("Image_"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".TIF").otherwise("")).alias("w"))
    files = _t(s, d, "part").select(F.concat(F.lit("image_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".tif").otherwise("_ch1.tiff")).alias("f"))
    return cohort.fuzzy_match(wanted, files, fx.clean_name(F.col("w")), fx.clean_name(F.col("f")))


FUZZY = """WITH w AS (SELECT DISTINCT 'image_' || s_suppkey AS wanted FROM supplier), f AS (SELECT DISTINCT 'image_' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '_ch1' END AS file FROM part),
x AS (SELECT wanted, file FROM w JOIN f ON wanted = file) SELECT * FROM x UNION ALL SELECT wanted, min(file) AS file FROM w JOIN f ON contains(wanted, file) OR contains(file, wanted) WHERE wanted NOT IN (SELECT wanted FROM x) GROUP BY wanted"""


def _fcs(s, d):
    v = F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).when(F.col("l_linenumber") == 2, F.lit(float("nan"))).when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_quantity"))
    return _t(s, d, "lineitem").select("l_returnflag", fx.finite_or_zero(v).alias("v")).groupBy("l_returnflag").agg(F.round(F.sum("v"), 6).alias("total"), F.count("v").alias("n"))


def _resume(s, d):
    """Orders as images, line numbers as steps; an artifact is missing where the quantity is small."""
    c = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("step"), (F.col("l_quantity") > 10).alias("present"))
    return cohort.resume_point(c, 6)


RESUME = """WITH c AS (SELECT l_orderkey AS image_id, l_linenumber AS step, min(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) AS ok FROM lineitem GROUP BY 1, 2), g AS (SELECT DISTINCT image_id, unnest(range(1, 7)) AS step FROM c),
x AS (SELECT g.image_id, min(g.step) AS gap FROM g LEFT JOIN c USING (image_id, step) WHERE coalesce(ok, 0) = 0 GROUP BY 1) SELECT i.image_id, CAST(coalesce(gap, 7) - 1 AS INTEGER) AS last_completed FROM (SELECT DISTINCT image_id FROM c) i LEFT JOIN x USING (image_id)"""


def _shown(results):
    """Test records with their p-values to six decimals."""
    return results.withColumns({c: F.round(c, 6) for c in ("P_Value", "P_Value_Corrected")})


def _tests(s, d):
    return _shown(cohort.bonferroni(cohort.run_tests(_rep(s, d), METRICS, "grp", "3D")))


def _pair_tests(s, d):
    two = _rep(s, d).where("grp in ('BUILDING', 'MACHINERY')")
    return _shown(cohort.uncorrected(cohort.run_tests(two, [*METRICS, "true_num_endpoints"], "grp", "3D")))


def _beta_sql(x: str, a: str, b: str, steps: int = 20_000) -> str:
    """The regularized incomplete beta function as an integral over the angle with sine sqrt(x), by Simpson's rule."""
    return f"""(SELECT 2 * exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) * sum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(sin(asin(sqrt({x})) * i / {steps}), 2 * {a} - 1) * pow(cos(asin(sqrt({x})) * i / {steps}), 2 * {b} - 1)) * asin(sqrt({x})) / {steps} / 3 FROM range({steps} + 1) r(i))"""


_LONG = "l AS (UNPIVOT (SELECT grp, l_quantity, l_extendedprice, l_discount FROM rep{}) ON l_quantity, l_extendedprice, l_discount INTO NAME metric VALUE v), m AS (SELECT metric, grp, count(*) AS n, avg(v) AS m, var_samp(v) AS q FROM l GROUP BY 1, 2)"
_RECORD = "'3D' AS \"Dataset\", array_to_string(list_transform(string_split(metric, '_'), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS \"Metric\", metric AS \"Raw_Metric\""
TESTS = f"""WITH {REPLICATES}, {_LONG.format('')}, g AS (SELECT metric, avg(v) AS g FROM l GROUP BY 1),
t AS (SELECT metric, count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(n * (m - g) * (m - g)) AS sb, sum((n - 1) * q) AS sw, string_agg(grp, ' vs ' ORDER BY grp) AS names FROM m JOIN g USING (metric) GROUP BY 1),
f AS (SELECT *, (sb / (k - 1)) / (sw / (n - k)) AS f, (n - k) / 2 AS a, (k - 1) / 2 AS b FROM t), p AS (SELECT *, 2 * a / (2 * a + 2 * b * f) AS x FROM f), r AS (SELECT *, {_beta_sql('x', 'a', 'b')} AS p FROM p)
SELECT {_RECORD}, names AS "Comparison", 'One-way ANOVA' AS "Test", round(f, 3) AS "Statistic", round(p, 6) AS "P_Value", round(least(1.0::DOUBLE, p * count(*) OVER ()), 6) AS "P_Value_Corrected", p * count(*) OVER () < 0.05 AS "Significant_After_Correction" FROM r"""
PAIR_TESTS = f"""WITH {REPLICATES}, {_LONG.format(" WHERE grp IN ('BUILDING', 'MACHINERY')")},
t AS (SELECT a.metric, a.grp || ' vs ' || b.grp AS names, (a.m - b.m) / sqrt(a.q / a.n + b.q / b.n) AS t, pow(a.q / a.n + b.q / b.n, 2) / (pow(a.q / a.n, 2) / (a.n - 1) + pow(b.q / b.n, 2) / (b.n - 1)) AS df FROM m a JOIN m b ON a.metric = b.metric AND a.grp < b.grp),
p AS (SELECT *, df / (df + t * t) AS x, df / 2 AS a, 0.5::DOUBLE AS b FROM t), r AS (SELECT *, {_beta_sql('x', 'a', 'b')} AS p FROM p)
SELECT {_RECORD}, names AS "Comparison", 'Welch t-test' AS "Test", round(t, 3) AS "Statistic", round(p, 6) AS "P_Value", round(p, 6) AS "P_Value_Corrected", p < 0.05 AS "Significant_After_Correction" FROM r"""


WANTED = [("3D", "l_quantity"), ("3D", "l_tax"), ("2D", "l_quantity"), ("3D", "l_discount")]


def _lookup(s, d):
    """What a figure's brackets show: the p-values of wanted metrics, null where nothing was tested."""
    return cohort.significance_lookup(_tests(s, d), s.createDataFrame(WANTED, "Dataset string, Raw_Metric string"))


LOOKUP = f"""WITH wanted("Dataset", "Raw_Metric") AS (VALUES {', '.join(map(str, WANTED))}), tests AS ({TESTS}) SELECT w.*, "P_Value", "P_Value_Corrected" FROM wanted w LEFT JOIN tests USING ("Dataset", "Raw_Metric")"""


def _final(s, d):
    """The table that is published: numbers that are none become null, columns that are absent are left out."""
    shown = _tests(s, d).withColumn("Statistic", F.when(F.col("Raw_Metric") == "l_discount", "n.a.").otherwise(F.col("Statistic").cast("string")))
    return cohort.final_table(shown, ["Dataset", "Metric", "Comparison", "Absent", "Statistic", "P_Value"])


FINAL = f"""WITH tests AS ({TESTS}) SELECT "Dataset", "Metric", "Comparison", CASE WHEN "Raw_Metric" <> 'l_discount' THEN "Statistic" END AS "Statistic", "P_Value" FROM tests"""


def _tiff(s, d):
    p = _t(s, d, "part").select("p_partkey", (F.col("p_size") % 4).cast("int").alias("u"), F.when(F.col("p_size") % 5 == 0, "micron").otherwise("").alias("t"), (F.col("p_retailprice") / F.when(F.col("p_size") % 2 == 0, 1e5).otherwise(100.0)).alias("q"))
    return p.select("p_partkey", F.round(fx.pixel_size(F.col("u"), F.col("t"), F.col("q")), 9).alias("um"))


def _xml(s, d):
    xml = F.concat(F.lit('<Pixels SizeC="'), F.col("p_size").cast("string"), F.lit('" PhysicalSizeX="0.'), F.col("p_partkey").cast("string"), F.lit('"/>'))
    return _t(s, d, "part").select("p_partkey", fx.ome_channels(xml).alias("channels"), fx.ome_size(xml, "X").alias("size_x"))


def _spacing(s, d):
    o = _t(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("t"))
    return o.select("o_orderkey", F.round(fx.spacing(F.col("t"), F.lit(512)), 9).alias("spacing"))


def _folders(s, d):
    """Documents' sources as folders: valid ones hold exactly one file of each of two kinds."""
    from ..sources.project import valid_folders

    p = _t(s, d, "part").select(F.concat(F.lit("/data/"), F.col("p_brand"), F.lit("/"), F.col("p_size").cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".tif").otherwise(".yaml")).alias("path"))
    return valid_folders(p)


FOLDERS = """WITH p AS (SELECT '/data/' || p_brand || '/' || p_size AS folder, p_partkey % 2 AS k FROM part) SELECT folder FROM p GROUP BY folder HAVING count(*) FILTER (k = 0) = 1 AND count(*) FILTER (k = 1) = 1"""

_REGISTERED = {
    "cohort_load_group_join": (
        _cohort_load,
        "SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority) AS Experimental_Group, coalesce(CAST(c_nationkey AS VARCHAR), CAST(o_custkey AS VARCHAR)) AS Batch FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    ),
    "group_unpivot": (
        _unpivot,
        "SELECT CAST(n_nationkey AS VARCHAR) AS Batch, 'Control' AS Experimental_Group, n_name AS Image_ID FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'Group2', 'im' || n_regionkey FROM nation",
    ),
    "two_level_mean": (lambda s, d: _rep(s, d).select("batch", "grp", *r6(*METRICS)), f"WITH {REPLICATES} SELECT batch, grp, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount FROM rep"),
    "cells_per_image": (lambda s, d: cohort.cells_per_image(cells(s, d), "image", "batch", "grp").select("batch", "grp", *r6("Cell_Count")), f"WITH {REPLICATES} SELECT batch, grp, round(cells, 6) AS Cell_Count FROM rep"),
    "replicate_table": (
        lambda s, d: cohort.replicates(cells(s, d), METRICS, "image", "batch", "grp").select("batch", "grp", *r6(*METRICS, "Cell_Count")),
        f"WITH {REPLICATES} SELECT batch, grp, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(cells, 6) AS Cell_Count FROM rep",
    ),
    "correlation_matrix": (
        lambda s, d: cohort.correlation_matrix(_t(s, d, "lineitem"), [*METRICS, "l_tax", "absent"]).select("metric_a", "metric_b", *r6("r")),
        "WITH p(a) AS (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')), u AS (SELECT row_number() OVER () AS i, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem), l AS (UNPIVOT u ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE v) SELECT x.metric AS metric_a, y.metric AS metric_b, round(corr(x.v, y.v), 6) AS r FROM l x JOIN l y USING (i) GROUP BY 1, 2",
    ),
    "welch_t": (_welch, WELCH),
    "anova_f": (_anova, ANOVA),
    "group_tests": (_tests, TESTS),
    "pair_tests": (_pair_tests, PAIR_TESTS),
    "significance_lookup": (_lookup, LOOKUP),
    "final_table": (_final, FINAL),
    "bonferroni": (
        _bonferroni,
        "WITH p AS (SELECT DISTINCT p_brand, p_size, CASE WHEN p_size % 7 <> 0 THEN p_size / 2000.0::DOUBLE END AS p FROM part), q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0::DOUBLE, p * count(p) OVER (PARTITION BY p_brand)) END AS c FROM p) SELECT p_brand, p_size, round(p, 6) AS p, round(c, 6) AS P_Value_Corrected, coalesce(c < 0.05, false) AS Significant_After_Correction FROM q",
    ),
    "box_stats": (
        lambda s, d: cohort.box_stats(_t(s, d, "lineitem"), "l_extendedprice", "l_returnflag").select("l_returnflag", "n", *r6("q25", "median", "q75", "upper_whisker", "highest")),
        "WITH q AS (SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.75) AS c, max(l_extendedprice) AS m FROM lineitem GROUP BY 1) SELECT l_returnflag, n, round(a, 6) AS q25, round(b, 6) AS median, round(c, 6) AS q75, round(CASE WHEN c > a THEN c + 1.5 * (c - a) ELSE c END, 6) AS upper_whisker, round(m, 6) AS highest FROM q",
    ),
    "density_histogram": (
        lambda s, d: cohort.density_histogram(_t(s, d, "lineitem"), "l_quantity", "l_returnflag").select("l_returnflag", "bin", *r6("density")),
        "WITH t AS (SELECT greatest(10.0, ceil(quantile_cont(l_quantity, 0.99))) AS t FROM lineitem), c AS (SELECT l_returnflag, CAST(least(t - 1, floor(l_quantity)) AS BIGINT) AS bin, count(*) AS n FROM lineitem, t WHERE l_quantity BETWEEN 0 AND t GROUP BY 1, 2) SELECT l_returnflag, bin, round(n::DOUBLE / sum(n) OVER (PARTITION BY l_returnflag), 6) AS density FROM c",
    ),
    "group_sizes": (
        lambda s, d: cohort.group_sizes(_t(s, d, "orders").where("o_orderstatus = 'F'"), "o_orderpriority", _t(s, d, "orders")),
        "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY 1",
    ),
    "union_missing_columns": (
        lambda s, d: cohort.union_cohorts(_t(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal"), _t(s, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")).select("k", F.round("c_acctbal", 6).alias("c_acctbal"), "s_name"),
        "SELECT c_custkey AS k, round(c_acctbal, 6) AS c_acctbal, NULL::VARCHAR AS s_name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier",
    ),
    "distinct_images": (lambda s, d: cells(s, d).groupBy("grp").agg(F.count_distinct("image").alias("images"), F.count_distinct("batch").alias("batches")), f"WITH {CELLS} SELECT grp, count(DISTINCT image) AS images, count(DISTINCT batch) AS batches FROM cells GROUP BY 1"),
    "regex_group": (
        _regex_groups,
        "SELECT CASE WHEN g = '' THEN '2D_Other' ELSE g END AS grp, count(*) AS n FROM (SELECT regexp_extract(CASE WHEN p_size % 3 = 0 THEN 'iba1-' ELSE 'neun-' END || p_size || CASE WHEN p_size % 2 = 0 THEN 'th_' ELSE 'x_' END || p_partkey, 'iba1-(\\d+(?:st|nd|rd|th))', 1) AS g FROM part) GROUP BY 1",
    ),
    "natural_sort": (_natural, "SELECT p_size, 'Image_' || min(p_partkey) || '.tif' AS \"first\", 'Image_' || max(p_partkey) || '.tif' AS \"last\" FROM part GROUP BY 1"),
    "axis_label_format": (
        _labels,
        "WITH m AS (SELECT DISTINCT lower(replace(p_type, ' ', '_')) || CASE p_size % 3 WHEN 0 THEN '_um' WHEN 1 THEN '_um2' ELSE '_um3' END AS metric FROM part) SELECT metric, array_to_string(list_transform(string_split(metric, '_'), lambda w: CASE w WHEN 'um' THEN 'µm' WHEN 'um2' THEN 'µm²' WHEN 'um3' THEN 'µm³' ELSE upper(w[1:1]) || lower(w[2:]) END), ' ') AS label FROM m",
    ),
    "significance_label": (
        _stars,
        "WITH q AS (SELECT DISTINCT p_size, p_size / 600.0::DOUBLE AS p FROM part) SELECT p_size, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars, CASE WHEN p < 0.001 THEN 'p<0.001' ELSE printf('p=%.3f', p) END AS text FROM q",
    ),
    "fuzzy_file_match": (_fuzzy, FUZZY),
    "fcs_clean": (_fcs, "SELECT l_returnflag, round(sum(CASE WHEN l_linenumber IN (1, 2, 3) THEN 0 ELSE l_quantity END), 6) AS total, count(*) AS n FROM lineitem GROUP BY 1"),
    "resume_point": (_resume, RESUME),
    "tiff_physical_scale": (
        _tiff,
        "WITH q AS (SELECT p_partkey, p_size % 4 AS u, p_size % 5 = 0 AS m, p_retailprice / CASE WHEN p_size % 2 = 0 THEN 1e5 ELSE 100.0::DOUBLE END AS q FROM part) SELECT p_partkey, round(CASE WHEN u = 3 THEN 10000.0 / q WHEN m THEN 1.0 / q WHEN u = 2 THEN 25400.0 / q WHEN q < 1 THEN q ELSE 1.0 / q END, 9) AS um FROM q",
    ),
    "ome_metadata": (_xml, "SELECT p_partkey, p_size AS channels, CAST('0.' || p_partkey AS DOUBLE) AS size_x FROM part"),
    "voxel_spacing": (_spacing, "SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice ELSE 1.0 END / 512.0::DOUBLE, 9) AS spacing FROM orders"),
    "folder_discovery": (_folders, FOLDERS),
}
QUERIES = {k: q for k, (q, _) in _REGISTERED.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in _REGISTERED.items() if sql}
