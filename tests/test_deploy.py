"""The driver contract works from any working directory (workers import the shipped package)."""

import os
import subprocess
import sys
import tempfile

import pytest

SCRIPT = r'''
import importlib.util
spec = importlib.util.spec_from_file_location("spark_entry", {entry!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.driver.bindAddress", "127.0.0.1").getOrCreate())
print("ROWS", m.entry(spark).count(), m.queries()["replay_quarantine"](spark, "/root/testdata/sf0.001").count())
'''


def test_entry_from_foreign_cwd():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    cwd = tempfile.mkdtemp(prefix="plyframe-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(entry=os.path.join(root, "__spark_entry__.py"))],
                         cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    line = [l for l in out.stdout.splitlines() if l.startswith("ROWS")]
    assert line, out.stderr[-2000:]
    _, flagship, quarantine = line[0].split()
    assert int(flagship) > 0 and int(quarantine) > 0


def test_bench_prints_one_json_line():
    import json
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py")], cwd=tempfile.mkdtemp(prefix="plyframe-b-"),
                         env=env, capture_output=True, text=True, timeout=900)
    lines = [l for l in out.stdout.splitlines() if l.strip()]
    assert len(lines) == 1, out.stdout[-2000:] + out.stderr[-2000:]
    doc = json.loads(lines[0])
    assert doc["unit"] == "sec" and doc["value"] > 0 and doc["sf"] == "0.001"
    assert set(doc["queries"]) >= {"extract_write", "game_positions", "pgn_flagship", "request_errors"}


def test_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from plyframe.session import checkpoint_root

    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=lambda k, v: conf.__setitem__(k, v)))

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_root(session(**{"spark.master": master}))
    assert checkpoint_root(session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
