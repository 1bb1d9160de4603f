"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "riskframe", max_partition_bytes: str = "8m") -> SparkSession:
    """Local session used by tests and the bench (a cluster brings its own).

    Small input splits so an 8-core machine gets several scan tasks on the
    small test files; a cluster keeps its own (e.g. 128m) split size.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.files.maxPartitionBytes", max_partition_bytes)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per context.

    Spark's own file service hands a small zip of the sources to every executor,
    so a job started from any folder, or on a cluster without the package
    installed, finds the functions that its tasks run.
    """
    sc = spark.sparkContext
    if getattr(sc, "_riskframe_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # inside a worker's zip there is nothing to ship
        target = os.path.join(tempfile.mkdtemp(prefix="riskframe-src-"), "riskframe.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("riskframe", os.path.relpath(full, root)))
        sc.addPyFile(target)
    sc._riskframe_shipped = True


#: bytecode beyond which the JVM leaves a method interpreted
_JIT_LIMIT = 8000


def compiled_projections(spark: SparkSession) -> None:
    """Wide projections in pieces that the JVM compiles: Spark's default lets one generated method grow to 65,535 bytes, which run interpreted (about ten times slower).

    A deployment's own setting stays.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(_JIT_LIMIT))


def _inside(path: str, folder: str) -> bool:
    """Whether ``path`` is ``folder`` or below it (as whole path parts, ``file:/x`` and ``file:///x`` alike)."""
    plain = [re.sub("^file:/+", "/", p).rstrip("/") for p in (path, folder)]
    return plain[0] == plain[1] or plain[0].startswith(plain[1] + "/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the deployment (a shared file
    system); only a local-mode session without one gets a fresh local folder.
    """
    ship_package(spark)
    compiled_projections(spark)
    sc = spark.sparkContext
    # the session setting wins: it names the shared folder of the cluster
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if conf_dir:
        if getattr(sc, "_riskframe_checkpoint", None) != (conf_dir, current):
            if not current or not _inside(current, conf_dir):
                sc.setCheckpointDir(conf_dir)
            sc._riskframe_checkpoint = (conf_dir, sc.getCheckpointDir())
        return sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running riskframe jobs")
    # (spark.checkpoint.dir is a static setting: only the context's folder can be set at run time)
    path = tempfile.mkdtemp(prefix="riskframe-ckpt-", dir=os.environ.get("RISKFRAME_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    import uuid

    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str, codec: str | None = None):
    """Cut lineage: write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Columnar and compressed (cheaper than a serialized RDD checkpoint), and the
    written files survive executor loss; a later stage never recomputes the input.
    ``codec``: a Parquet compression other than the session's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote under its checkpoint folder (any file system Spark knows)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if not path.startswith(f"{base}/scratch/"):
        raise ValueError(f"{path} is not a scratch folder of this session")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
