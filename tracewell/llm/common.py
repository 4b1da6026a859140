"""What the operators of this package share: identity columns, shared-folder cuts, Arrow loops."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..workers import ship_package


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that setting is missing in local mode, an error on a cluster."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if given is None:
        given = sc.getCheckpointDir()
    if given is None and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if given is None:
        given = "file://" + tempfile.mkdtemp(prefix="shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before the interpreter  # noqa: BLE001
        pass


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts(column: pa.Array, piece: int = 256) -> Iterator[str | None]:
    """The strings of an Arrow column, a few at a time so that a batch isn't held twice."""
    for at in range(0, len(column), piece):
        yield from column.slice(at, piece).to_pylist()


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id's text leaves 1 when divided by 3; a missing id isn't held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def one_of(name: str, columns: list[str]) -> str:
    """A working column's name that no column of the input has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
