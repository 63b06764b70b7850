import pytest

from grantstar.session import (
    RUNTIME_CONF,
    TASK_SHARE,
    concurrently,
    files_below,
    share_out,
    shared_folder,
    table_stage,
    tune,
)


def test_a_stage_writes_each_name_once(spark, tmp_path):
    stage = table_stage(spark, str(tmp_path))
    first, second = concurrently(
        lambda: stage(spark.range(3), "numbers"), lambda: stage(spark.range(3), "numbers")
    )
    assert first is second and first.count() == 3
    assert str(tmp_path) in first.inputFiles()[0]


def test_a_stage_may_leave_frames_lazy(spark, tmp_path):
    stage = table_stage(spark, str(tmp_path), names=("kept",))
    df = spark.range(2)
    assert stage(df, "other") is df
    assert stage(df, "kept") is not df


def test_stages_of_different_runs_do_not_meet(spark):
    one, two = table_stage(spark), table_stage(spark)
    left, right = one(spark.range(1), "t"), two(spark.range(2), "t")
    assert (left.count(), right.count()) == (1, 2)


def test_errors_of_concurrent_tasks_surface(spark):
    def broken():
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        concurrently(broken, lambda: 1)


def test_tune_sets_the_skew_handling(spark):
    key = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    spark.conf.set(key, "false")
    tune(spark)
    assert {k: spark.conf.get(k) for k in RUNTIME_CONF} == RUNTIME_CONF


def test_a_task_gets_no_larger_share_of_a_larger_input(spark):
    share, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
    before = spark.conf.get(parts)
    try:
        for given, kept in (("64MB", f"{TASK_SHARE}b"), ("64m", f"{TASK_SHARE}b"), ("8m", "8m")):
            spark.conf.set(share, given)
            tune(spark)
            assert spark.conf.get(share) == kept
        for size, expected in ((0, before), (TASK_SHARE, before), (1000 * TASK_SHARE + 1, "1001"), (TASK_SHARE, "1001")):
            share_out(spark, size)
            assert spark.conf.get(parts) == expected
    finally:
        spark.conf.set(parts, before)
        spark.conf.unset(share)


def test_a_closed_stage_leaves_no_tables(spark, tmp_path):
    stage = table_stage(spark, str(tmp_path))
    stage(spark.range(3), "numbers")
    assert files_below(spark, str(tmp_path))
    stage.close()
    assert files_below(spark, str(tmp_path)) == []


class Cluster:
    """A session as far as the shared folder is concerned."""

    def __init__(self, **settings):
        self.conf = settings


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster(**{"spark.master": master}))
    assert shared_folder(Cluster(**{"spark.master": master, "spark.checkpoint.dir": "/x"})) == "/x"


def test_one_machine_may_do_without():
    assert "grantstar-" in shared_folder(Cluster(**{"spark.master": "local[4]"}))
