"""What the operators share: the shared folder, written tables, a filter of keys and input checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session; only where that is unset (tests on one
    machine) a temporary folder is made and used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="recollect-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session ended first
        return
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except OSError:  # the gateway is already closed
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends here, and a lost executor costs nothing before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Filter:
    """A Bloom filter of 64-bit keys: what it lets through may be among them, what it stops is not.

    It has 16 bits for each key, but at most `MOST` words (16 MB), so it can be sent to every task whatever the number of keys.  Beyond
    some ten million keys it lets more and more through: what is done with the rest has to be exact, and only costs more.
    """

    words: np.ndarray  # of 64 bits

    MOST = 1 << 21
    HASHES = 4

    @staticmethod
    def mixed(keys: np.ndarray, k: int) -> np.ndarray:
        h = keys.view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 & 2**64 - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """The filter of the only column of `keys`; its words are made in the tasks, and only they come to the driver."""
        import pyarrow as pa

        size = 1
        n = keys.count()
        while size * 4 < n and size < cls.MOST:
            size *= 2

        def bits(batches):
            words = np.zeros(size, np.uint64)
            for batch in batches:
                x = batch.column(0).to_numpy()
                for k in range(cls.HASHES):
                    h = cls.mixed(x, k)
                    np.bitwise_or.at(words, (h >> np.uint64(6)) % np.uint64(size), np.uint64(1) << (h & np.uint64(63)))
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["at", "word"])

        found = keys.mapInArrow(bits, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        words = np.zeros(size, np.uint64)
        words[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
        return cls(words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for k in range(self.HASHES):
            h = self.mixed(np.ascontiguousarray(keys), k)
            found &= (self.words[(h >> np.uint64(6)) % np.uint64(len(self.words))] >> (h & np.uint64(63))) & np.uint64(1) == 1
        return found


#: Rows that Spark sends to a Python task at once.  Texts are a few thousand characters and some far more, so the default of 10,000 would be 50 MB on either side.
ROWS = 1000


def few_rows_a_batch(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to `ROWS`, where they are more; a setting below that stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ROWS:
        spark.conf.set(name, ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows_a_batch(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text"):
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
