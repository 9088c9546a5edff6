"""What the operators share: input columns, Arrow maps, shared storage, bounded samples."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most (in expectation).
MAX_TRAINING_ROWS = 12_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Folders and tables that the operators have made in this process, for `discard`.
_made: list[tuple[str, str]] = []


def prepare(spark: SparkSession) -> None:
    """Settings of a session that runs these operators: Arrow batches of bounded rows and bytes.

    The entry points (queries, stages of the pipeline) call this; the operators change no
    settings. Without it they give the same results with Spark's own, larger batches.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent (tests, one machine) the warehouse folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"
    _made.append(("folder", path))
    return path


def bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """`df` written to the shared folder as a table of `buckets` buckets by `by`, and read back."""
    spark, name = df.sparkSession, f"quern_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, by).write.bucketBy(buckets, by).option("path", shared_folder(spark)).option("compression", "zstd")
    writer.saveAsTable(name)
    _made.append(("table", name))
    return spark.table(name)


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends there.

    The files stay until `discard` or the cluster's own cleaning of the folder: results
    are read from them when a caller asks for rows.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """What to give `discard` later, to remove what is made from now on."""
    return len(_made)


def discard(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Removes the folders and tables made after `since`, but for the last `but` of them.

    Only for results that nobody will read again. Where the session has no JVM gateway
    nothing is removed.
    """
    gone, _made[since:] = _made[since : len(_made) - but], _made[len(_made) - but :]
    jvm = getattr(spark, "_jvm", None)
    for kind, name in gone:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        elif jvm is not None:
            where = jvm.org.apache.hadoop.fs.Path(name)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over.

    It does so when the driver finds that nothing refers to them, that is after a
    collection of garbage, which may else not come for long. Only disk is saved: nothing
    else depends on it, and sessions without a JVM gateway go on without.
    """
    gc.collect()
    if getattr(spark, "_jvm", None) is not None:
        spark._jvm.System.gc()


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """`f` over each Arrow batch of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def fresh(name: str, *frames: DataFrame) -> str:
    """`name`, or with underscores behind it, so that no column of `frames` is called so in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with more than one in HEAVY of all rows counts as heavy: there are fewer than HEAVY.
HEAVY = 1000


def joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined to right, whose `key` is unique; no task gets all rows of a heavy key.

    The rows of `right` for heavy keys of `left` are fewer than HEAVY and are broadcast,
    all others are shuffled. `left` is read three times and should be stored.
    """
    total = left.count()
    heavy = left.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") * HEAVY > total).select(key)
    few = F.broadcast(right.join(F.broadcast(heavy), key, "left_semi"))
    rest = left.join(F.broadcast(heavy), key, "left_anti").join(right, key)
    return left.join(few, key).select(rest.columns).unionByName(rest)


#: A bitmap has 2 ** 27 bits (16 MB) at most, however many keys it stands for.
MOST_BITS = 27


class Bitmap:
    """Which 64-bit keys may be among some; each key has two places, both set for a member.

    Keys that are not in it are certainly none of them. With very many keys it fills up
    and tells nothing any more: users must stay right then.
    """

    def __init__(self, keys: DataFrame, key: str):
        n = keys.count()
        self.bits = int(min(MOST_BITS, max(18, np.ceil(np.log2(512 * max(n, 1))))))
        places = F.array(F.shiftrightunsigned(key, 64 - self.bits), F.shiftrightunsigned(key, 64 - 2 * self.bits).bitwiseAND((1 << self.bits) - 1))
        place = F.col("place")
        words = keys.select(F.explode(places).alias("place")).select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), (place % 64).cast("int").alias("bit"))
        words = words.groupBy("word").agg(F.expr("bit_or(shiftleft(one, bit))").alias("set")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.int64)
        self.words[np.asarray(words["word"])] = np.asarray(words["set"])

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        words, out = self.words.view(np.uint64), np.ones(len(keys), bool)
        for shift in (64 - self.bits, 64 - 2 * self.bits):
            place = ((keys >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            out &= (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def fold(doc_id: str = "doc_id"):
    """The fold of a document: crc32 of its id as text, modulo 5. Fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def bounded(df: DataFrame, most: int, *by: str) -> DataFrame:
    """About `most` rows of `df` at most: all rows, or the share with the lowest hashes.

    The columns `by` must tell rows apart; equal ones are chosen together.
    """
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(*(F.col(c) for c in by)), F.lit(1_000_000)) < int(1e6 * most / n))


def labelled(labels: DataFrame, label: str, most: int) -> DataFrame:
    """k, y: about `most` labelled ids at most, one row each.

    Null ids and labels are left out. An id with several labels has the one that most of
    its rows carry, 1 where they are even.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IS NOT NULL")
    return bounded(rows.groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y")), most, "k")


def arrays(table: pa.Table, name: str):
    """Offsets and flat values of a list column."""
    column = table[name].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    at = np.asarray(column.offsets, dtype=np.int64) if len(column) else np.zeros(1, np.int64)
    return at - at[0], np.asarray(column.flatten())
