"""What the operators of this subpackage share: the shared scratch folder, and reading tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is missing and all runs in one process (local tests) is a temporary folder made and set.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Spark's setting of the bytes of an Arrow batch, its default, and what the operators here take instead.
BATCHES, USUAL, FEWER = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of 2 MiB in this session, unless it has a size of its own. By the default 10,000 texts, 25 MB
    and more, stand in the buffers of the JVM and of each worker at once."""
    if str(spark.conf.get(BATCHES, str(USUAL))).rstrip("b") == str(USUAL):
        spark.conf.set(BATCHES, str(FEWER))


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor only costs the tasks it ran."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        bound_batches(spark)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows as Parquet and returns a reader of them."""
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def again(self, t: DataFrame) -> DataFrame:
        """Another reader of a written table, whose columns are not taken for those of the first."""
        return self.spark.read.schema(t.schema).parquet(t._scratch_path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            where = t if isinstance(t, str) else getattr(t, "_scratch_path", None)
            if where:
                path = jvm.org.apache.hadoop.fs.Path(where)
                path.getFileSystem(conf).delete(path, True)


_sole: dict = {}


def sole(key, make):
    """What make() gives, kept in a worker process under the key. A worker that serves one stage after another keeps one such
    memory at a time: that of another stage is dropped first."""
    if key not in _sole:
        release()
        _sole[key] = make()
    return _sole[key]


def release() -> None:
    """Drops what sole() keeps, and hands freed memory back to the system; for stages that keep nothing."""
    if _sole:
        _sole.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint128(c: Column) -> Column:
    """Two independent 64-bit hashes: values that agree in both are taken for equal (at 10^10 values a chance of 1e-19
    that any two others agree)."""
    return F.struct(F.xxhash64(c).alias("h"), F.xxhash64(F.lit(0x5EED), c, F.lit(0xC0DE)).alias("g"))


#: Bits of the map that marks ids: 8 MiB in all, whatever the number of ids.
MAP_BITS = 1 << 26


def marked(rows: DataFrame, key: Column, ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    """rows with flag: false only where the key is surely none of the ids (longs).

    The ids are hashed into a bit map of fixed size, which is broadcast; so rows that cannot match need not be shuffled to
    meet them. More ids than the map has room for only make more rows pass."""
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(MAP_BITS))
    of_ids = place(F.col(id_col))
    maps = ids.groupBy(F.bitmap_bucket_number(of_ids).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(of_ids)).alias("_bits"))
    own = rows.withColumn("_own", F.bitmap_bucket_number(place(key))).withColumn("_bit", F.bitmap_bit_position(place(key)))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(F.col("_bit"), F.lit(8)).cast("int")) == 1
    out = own.join(F.broadcast(maps), F.col("_own") == F.col("_bucket"), "left")  # MAP_BITS / 8 bytes at most
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).select(*rows.columns, flag)
