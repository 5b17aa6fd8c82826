"""Session helpers shared by all operators: table reads and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; only a local session may fall back to its own.

    A machine-local folder would be lost with its executor, so on a cluster without the setting this raises.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="evigraph-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: iterative plans stay short, and lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder, not made yet, within the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that shared_folder named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions in force."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A schema with further fields."""
    return T.StructType(schema.fields + T.StructType.fromDDL(ddl).fields)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per session, whose Python workers may not have it on their path."""
    sc = spark.sparkContext
    if not getattr(sc, "_evigraph_shipped", False):
        root = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="evigraph-code-")) / "evigraph.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(out))
        sc._evigraph_shipped = True
    return spark
