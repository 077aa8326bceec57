"""What the driver has to remember: rounds over little data may not start a task for each shuffle partition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from findinglake.llm.components import components
from findinglake.llm.partenum import _labels
from findinglake.llm.quality_mcd import estimates


@pytest.fixture
def many(spark):
    """A session whose every shuffle has 64 partitions, as on a large cluster; gives a counter of tasks."""
    new = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    sc = spark.sparkContext

    def tasks(name, f):
        sc.setJobGroup(name, name)
        out = f()
        tracker = sc.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(name)]
        stages = {i for j in jobs if j for i in j.stageIds}
        return out, sum(s.numCompletedTasks for i in stages if (s := tracker.getStageInfo(i)))

    yield tasks
    sc.setLocalProperty("spark.jobGroup.id", None)
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_round_of_components_over_few_edges_is_one_task(spark, many):
    chain = spark.range(400).select((F.col("id") * 7 + 7).alias("a"), (F.col("id") * 7).alias("b"))
    got, n = many("components", lambda: components(chain).collect())
    assert {r.node: r.component for r in got} == {7 * i: 0 for i in range(1, 401)}
    assert n < 1000, n  # 2,637 when each step was shuffled


def test_labels_of_few_links_are_one_task(spark, many):
    chain = spark.range(40).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    got, n = many("labels", lambda: _labels(chain, hops=3).collect())
    assert {r.doc: r.label for r in got} == {i: max(0, i - 3) for i in range(41)}
    assert n < 64, n  # 224


def test_steps_of_an_estimate_shuffle_few_partitions(spark, many):
    rnd = np.random.default_rng(3)
    rows = [(k, rnd.normal(size=6).tolist()) for k in "abc" for _ in range(120)]
    table = spark.createDataFrame(rows, "key string, v array<double>")
    got, n = many("estimates", lambda: estimates(table, steps=3).collect())
    assert sorted(r.key for r in got) == ["a", "b", "c"] and {r.rows for r in got} == {120}
    assert n < 2200, n  # 4,453
