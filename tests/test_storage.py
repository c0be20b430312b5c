"""Paths of the shared folder."""

from __future__ import annotations

import pytest

from glossator.sources import storage


def test_plain_paths_get_the_default_file_system(spark):
    assert storage.qualified(spark, "/a/b") == "file:///a/b"
    assert storage.qualified(spark, "file:/a/b") == "file:///a/b"
    assert storage.shared_dir(spark).startswith("file:///")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.defaultFS", "viewfs://other/")
    conf.set("fs.viewfs.mounttable.other.link./in", "file:///tmp")
    try:
        assert storage.qualified(spark, "/in/x") == "viewfs://other/in/x"
        assert storage.qualified(spark, "file:///a/b") == "file:///a/b"
    finally:
        conf.unset("fs.defaultFS")


def test_a_cluster_needs_a_folder(monkeypatch):
    class Held:
        def isDefined(self):
            return False

    class Context:
        master = "yarn"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Held()})()})()

    class Session:
        conf = type("C", (), {"get": lambda self, k, d=None: d})()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())
