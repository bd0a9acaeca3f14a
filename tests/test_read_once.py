from volumetra.operators import registration
from volumetra.plans import jobs

SF = "/root/testdata/sf0.001"


def test_stitching_reads_the_table_once(spark):
    plan = jobs.QUERIES["stitch_turned_copy"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan  # only the stored voxels


def test_candidates_are_read_once(spark):
    found = registration.robust_models(jobs._candidates(spark, SF), "TRANSLATION", local=100, iterations=20, max_error=10.0, min_ratio=0.01, min_inliers=5)
    assert "lineitem" not in found._jdf.queryExecution().executedPlan().toString()
