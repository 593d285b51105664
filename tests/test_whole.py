"""Queries that take all objects and rows of their tables, against brute force on small tables."""

import math

from cellplan import plans


def test_distances_of_all_objects(spark, tmp_path):
    """Every pair, however far apart, and objects of one pixel too."""
    at = {0: 1, 3: 2, 4: 2, 60: 3, 61: 3, 62: 3, 161: 3, 162: 3, 199: 4}  # event ids of bright pixels, 100 a row, and their objects
    spark.range(200).selectExpr("id AS event_id", f"CAST(id IN ({', '.join(map(str, at))}) AS DOUBLE) AS value", "'view' AS event_type", "id AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    ids = {n: min(k for k, m in at.items() if m == n) for n in set(at.values())}
    want = {}
    for p, a in at.items():
        for q, b in at.items():
            if a < b:
                d = math.dist(divmod(p, 100), divmod(q, 100))
                want[ids[a], ids[b]] = min(d, want.get((ids[a], ids[b]), d))
    got = {(r.label_a, r.label_b): r.distance_um for r in plans.queries()["pairwise_distance_matrix"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    near = {r.label: r.closest_neighbor_label for r in plans.queries()["nearest_neighbor"](spark, str(tmp_path)).collect()}
    assert near == {0: 3, 3: 0, 60: 199, 199: 60} and {(r.mask1, r.mask2) for r in plans.queries()["contact_points"](spark, str(tmp_path)).collect()} == set(near.items())


def test_files_and_groups_of_all_rows(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (2, 3, 5, 8, 999)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k,) for k in (2, 3, 4, 5, 51)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.wanted, r.file) for r in plans.queries()["fuzzy_file_match"](spark, str(tmp_path)).collect()}
    assert got == {("image_2", "image_2"), ("image_3", "image_3_ch1"), ("image_5", "image_51_ch1")}
    spark.createDataFrame([(1, 7, "own"), (2, 8, "own"), (3, 9, "own")], "o_orderkey bigint, o_custkey bigint, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 3, "a"), (8, 20, "b")], "c_custkey bigint, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.o_orderkey, r.Experimental_Group) for r in plans.queries()["cohort_load_group_join"](spark, str(tmp_path)).collect()}
    assert got == {(1, "a"), (2, "b"), (3, "own")}
