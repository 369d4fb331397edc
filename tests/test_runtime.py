import os
import time
from types import SimpleNamespace

import pytest

from codexlake import runtime
from codexlake.operators import mutations


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,3000]"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            runtime.shared_dir(session)


def test_the_clusters_folder_is_used():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "/shared/x/"), sparkContext=None)
    assert runtime.shared_dir(session) == "/shared/x"


def test_staged_tables_are_deleted(spark):
    one, two = (runtime.staged(spark.range(n), "numbers") for n in (3, 4))
    paths = [runtime._STAGED[df] for df in (one, two)]
    assert [one.count(), two.count()] == [3, 4] and all(map(os.path.exists, paths))
    runtime.discarded(one)
    assert [os.path.exists(p) for p in paths] == [False, True]
    runtime.discarded(one)
    assert runtime.release(spark) >= 1 and not os.path.exists(paths[1]) and runtime.release(spark) == 0


def test_staged_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key, None)

    def files():
        return {name for name in (disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())) if name.startswith("shuffle_")}

    before = files()
    df = runtime.staged(spark.range(1000).repartition("id"), "numbers", free=True)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and df.count() == 1000 and spark.conf.get(key, None) == setting


def test_samples_are_bounded(spark):
    many = spark.range(20_000).selectExpr("id", "0 AS one")
    assert 100 < runtime.bounded_sample(many, "id", 500, 20_000).count() <= 1000
    assert runtime.bounded_sample(many, "one", 500, 20_000).count() <= 1000
    assert runtime.bounded_sample(many, "id", 30_000, 20_000).count() == 20_000


def test_pointer_names_the_latest_version(spark, tmp_path):
    versions = [mutations.publish({"a": spark.range(n)}, f"file://{tmp_path}") for n in (1, 2, 3)]
    assert versions[-1] in (tmp_path / "CURRENT").read_text() and mutations.published(spark, f"file://{tmp_path}", "a").count() == 3
    assert not [p for p in os.listdir(tmp_path) if p.startswith("CURRENT.v-")]
