from types import SimpleNamespace

import pytest

from tessera import session


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    conf = SimpleNamespace(get=lambda *_: None)
    of = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            session.scratch(of(master), "x")
    assert "x-" in session.scratch(of("local[4]"), "x")


def test_clearing_removes_what_was_written(spark):
    kept = session.cut(spark.range(5), "kept")
    folder = kept.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    from pathlib import Path

    assert kept.count() == 5 and Path(folder).exists()
    session.clear(spark)
    assert not Path(folder).exists()
    session.clear(spark)
