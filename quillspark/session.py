"""Sessions, and shipping this package to a session's Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PACKAGE = Path(__file__).resolve().parent
#: Spark's setting to remove the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, app: str = "quillspark", **conf: str) -> SparkSession:
    """A session with the settings the engine assumes; dots in names of settings are written ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def written(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by files in the folder of ``spark.checkpoint.dir``, so a lost executor costs
    a re-read. A temporary folder stands in only where none is set and the executors are local (tests)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quill-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which ``spark.checkpoint.dir`` names. A temporary one stands
    in only where none is set and the executors are local (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="quill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, computed once; a lost executor costs a re-read. Shuffle files
    of the write go when it ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer partitions than there are, as one small file does; a table
    that has enough of them isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def arrow_types(schema: str):
    """The Arrow schema of a Spark schema string, for functions that make batches."""
    return to_arrow_schema(StructType.fromDDL(schema))


def ship(spark: SparkSession) -> None:
    """Give the Python workers of a session this package, once, wherever the driver runs from."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspark", False):
        return
    out = Path(tempfile.mkdtemp(prefix="quill-")) / "quillspark.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, Path("quillspark") / p.relative_to(PACKAGE))
    sc.addPyFile(str(out))
    sc._quillspark = True
