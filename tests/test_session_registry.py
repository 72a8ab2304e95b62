"""Shared folder, per-call intermediates and a registry that needs nothing from the installation."""

import builtins
import threading

import pytest

from tessera import session
from tessera.plans import registry


class Conf(dict):
    def set(self, k, v):
        self[k] = v


class Cluster:
    """The part of a session that the lookup reads."""

    def __init__(self, master, **conf):
        self.conf = Conf({"spark.master": master, **conf})
        self.sparkContext = self

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, d):
        self.dir = d


def test_unset_folder_fails_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir is not set"):
            session.scratch_path(Cluster(master), "x")
    assert session.scratch_path(Cluster("yarn", **{"spark.checkpoint.dir": "hdfs:///shared"}), "x").startswith("hdfs:///shared/")
    assert session.ensure_checkpoint_dir(Cluster("local[4]"))


def test_scratch_is_removed(spark):
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert session.clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_shared_intermediates_belong_to_one_call(spark):
    made = []

    @registry.shared
    def part(spark, sf):
        made.append(threading.get_ident())
        return spark.range(2)

    def build(spark, sf):
        return part(spark, sf).union(part(spark, sf))

    registry.query("_test_shared")(build)
    try:
        run = registry.QUERIES["_test_shared"]
        threads = [threading.Thread(target=lambda: run(spark, "x")) for _ in range(2)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(made) == 2 and len(set(made)) == 2
        assert run(spark, "x").count() == 4 and len(made) == 3
    finally:
        del registry.QUERIES["_test_shared"]


def test_registry_reads_no_files_of_the_installation(monkeypatch):
    import importlib
    import zipfile

    import tessera.functions.stopwords as stopwords
    import tessera.plans.sqlparts as sqlparts

    def refuse(*a, **k):
        raise FileNotFoundError(a)

    monkeypatch.setattr(zipfile, "ZipFile", refuse)
    monkeypatch.setattr("glob.glob", lambda *a, **k: [])
    opened = builtins.open
    monkeypatch.setattr(builtins, "open", lambda f, *a, **k: refuse(f) if ".jar" in str(f) else opened(f, *a, **k))
    importlib.reload(stopwords)
    importlib.reload(sqlparts)
    import __spark_entry__ as entry
    assert len(entry.queries()) > 90 and len(entry.oracle_sql()) > 80
    assert len(stopwords.profile_stopwords()) == 186


def test_one_bad_module_loses_its_own_queries_only(monkeypatch):
    from tessera.plans import catalog
    assert catalog.FAILED == {} and len(catalog.QUERIES) > 80
