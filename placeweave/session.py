"""Sessions and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, so that they need no installation."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="placeweave-ship-")) / "placeweave.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary folder serves, but
    only when the master is local; a cluster without the setting is refused, since its machines share no folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="placeweave-")
    return _LOCAL_SCRATCH[app]


def own_scratch(spark: SparkSession) -> str:
    """A folder of this application's own: others may share the folder at the same time."""
    return f"{scratch_dir(spark)}/placeweave-scratch/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is cut, the rows are computed once (an
    eager ``checkpoint()`` computes its last stage twice), and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{own_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


def let_go(spark: SparkSession) -> None:
    """Ask the JVM to let go of plans that are done with, and so of their shuffle files, which else stay on the disks until it
    collects by itself. Python's own garbage holds plans too."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` once all that is read from them has been written itself."""
    for t in tables:
        let_go(t.sparkSession)
        if (known := _PATHS.pop(id(t), None)) is not None:
            jvm = t.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(known[1])
            path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this application's ``materialize`` wrote; call it when no result that depends on it is still to be read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(own_scratch(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)
    _PATHS.clear()


def small_side(df: DataFrame, name: str, most: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """``df``, written once, as the side of a join: marked for broadcast if it has at most ``most`` rows, which are counted, and
    at most ``most_bytes`` of text beside 16 bytes a column; otherwise left to a shuffled join."""
    from pyspark.sql import functions as F

    written = materialize(df, name)
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in written.schema if f.dataType.simpleString() == "string"]
    rows, size = written.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(16 * len(written.columns)))), F.lit(0))).first()
    return F.broadcast(written) if rows <= most and size <= most_bytes else written
