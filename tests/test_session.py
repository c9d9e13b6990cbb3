"""Checkpoint folder rules and cluster suggestions."""

from __future__ import annotations

import pytest

from starcart import session


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Context:
    def __init__(self, master, current=None):
        self.master = master
        self.current = current

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


class _Session:
    def __init__(self, master, conf=(), current=None):
        self.sparkContext = _Context(master, current)
        self.conf = _Conf(conf)


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(_Session("yarn"))


def test_configured_folder_is_used():
    s = _Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert session.checkpoint_dir(s) == "hdfs:///shared/ckpt"
    assert session.checkpoint_dir(_Session("yarn", current="s3://b/ck")) == "s3://b/ck"


def test_local_session_gets_a_scratch_folder():
    path = session.checkpoint_dir(_Session("local[2]"))
    assert "starcart-ckpt-" in path


def test_scale_configs_only_fill_unset_keys():
    s = _Session("yarn", {"spark.sql.shuffle.partitions": "4000"})
    applied = session.scale_configs(s)
    assert "spark.sql.shuffle.partitions" not in applied
    assert s.conf.get("spark.sql.shuffle.partitions") == "4000"
    assert s.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
