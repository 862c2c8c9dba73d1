"""Session helpers: local session for tests/bench, shared scratch paths, broadcast bound."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "plyframe",
                  event_log_dir: str | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on).

    ``event_log_dir`` turns on Spark's event log there (stage and task times
    without the web UI)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.bindAddress", "127.0.0.1")
               .config("spark.driver.host", "127.0.0.1")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", os.environ.get("PLYFRAME_DRIVER_MEMORY", "8g")))
    if event_log_dir:
        os.makedirs(event_log_dir, exist_ok=True)
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: The folder each application without the setting uses.
_ROOTS: dict = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is the configured shared location, and its absence is an
    error: executors do not see one another's disks.  Only on a local master
    (tests) is a folder made under the system temp folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: configuration only
        sc = None
    app = sc.applicationId if sc is not None else None
    root = root or (_ROOTS.get(app) if app else None)
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="plyframe-ckpt-")
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    if app:
        _ROOTS[app] = root  # the setting itself is static: a session can not be given another
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/plyframe/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``plyframe`` importable in every Python worker of this session.

    The replay and FEN UDFs resolve their helpers by module name on the
    executors, so the package travels with the job as a zip (``addPyFile``;
    ``addArtifacts`` on a Spark Connect session).  Done once per application.
    """
    import zipfile

    try:
        app = spark.sparkContext.applicationId
    except Exception:
        app = spark.conf.get("spark.app.id", None) or str(id(spark))
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    # Driver-side artifact only: Spark itself serves it to every executor, so
    # it is not job data and needs no shared folder.
    path = os.path.join(tempfile.mkdtemp(prefix="plyframe-pkg-"), "plyframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.join("plyframe", os.path.relpath(full, pkg)))
    try:
        spark.sparkContext.addPyFile(path)
    except Exception:  # Spark Connect
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(app)
