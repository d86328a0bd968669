"""Session defaults and the folder in which intermediate results are cut off from their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}


def build_session(app: str = "strandflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults (UTC, AQE with skew join, Arrow); ``conf`` overrides them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # A scorer call may have side effects: never run it twice on purpose.
        "spark.speculation": "false",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may do without the setting (as in tests): it then gets a temporary folder,
    which goes when the process ends. Elsewhere a missing setting is an error, since a folder of one
    machine can't be read by the executors of another.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="strandflow-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def scratch_path(spark: SparkSession, what: str = "t") -> str:
    """A new path in the shared folder, which ``sweep`` deletes with all that was written under it."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, what: str = "t") -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, and read back.

    Cuts lineage like ``checkpoint()``: the result survives the loss of executors, is compressed and
    columnar, and its size is known to the planner when it picks join strategies.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end the tables that were staged within, but for those put in the list; nothing may read them later."""
    before, keep = set(_STAGED.get(spark.sparkContext.applicationId, [])), []
    yield keep
    kept = {getattr(df, "_staged_path", None) for df in keep}
    paths = _STAGED.get(spark.sparkContext.applicationId, [])
    for p in [p for p in paths if p not in before and p not in kept]:
        _delete(spark, p)
        paths.remove(p)


def unstaged(df: DataFrame) -> None:
    """Deletes the table behind a frame that ``staged`` gave, once nothing that is still to run reads it."""
    if path := getattr(df, "_staged_path", None):
        _delete(df.sparkSession, path)
        _STAGED[df.sparkSession.sparkContext.applicationId].remove(path)


def sweep(spark: SparkSession) -> int:
    """Deletes all tables that this application staged, for when its results have been written; gives their number."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        _delete(spark, p)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
