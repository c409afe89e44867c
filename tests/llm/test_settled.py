"""Chains within a delivery: one task settles them as the rounds do, in fewer jobs of the driver."""

from corvane.llm.history import History


def test_one_task_settles_as_rounds_do(spark, tmp_path, rows):
    history = History.create(spark, f"file://{tmp_path}/h", "bigint")
    chain = [(k, k + 1, False) for k in range(10, 16)] + [(10, 14, False), (1, 20, True), (20, 21, False), (21, 22, False), (3, 12, True)]
    edges = history.scratch.keep(spark.createDataFrame(chain, "id_a bigint, id_b bigint, old boolean").repartition(3))
    got = rows(history._resolve(edges).distinct())
    assert got == rows(history._resolve(edges, at_once=0).distinct()) == [(11,), (12,), (14,), (16,), (20,), (22,)]
    assert history._resolve(edges.limit(0)).count() == 0
    history.close()


def test_settling_takes_few_jobs(spark, tmp_path):
    """Rounds of a chain of six took over twenty jobs."""
    history = History.create(spark, f"file://{tmp_path}/h", "bigint")
    edges = history.scratch.keep(spark.createDataFrame([(k, k + 1, False) for k in range(6)], "id_a bigint, id_b bigint, old boolean"))
    spark.sparkContext.setJobGroup("settle", "")
    history._resolve(edges).count()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("settle"))
    spark.sparkContext._jsc.clearJobGroup()
    history.close()
    assert jobs <= 6
