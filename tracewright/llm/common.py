"""What several operators of this subpackage share: tables, the shared folder,
joins with a checked size, running sums over a global order, prefix sums in arrays.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a side that is broadcast at most; beyond it a join is shuffled.
BROADCAST_ROWS = 200_000

#: Parts in which equal rows are counted first.
PARTS = 256

#: What counts as a word where only white space parts words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` as the cluster sets it. Only where that is unset and the
    master is local, as in tests, a temporary folder is made and set as checkpoint folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    if not folder:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="tracewright-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        context.setCheckpointDir(f"file://{local}")
        folder = context.getCheckpointDir()
    _removed_at_end(spark, context.getCheckpointDir())  # a folder of this application's own
    return folder


def _removed_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system delete a path when the application ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it again: lineage ends there.

    The files stay as long as the application, as frames that read them may; then they go.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _removed_at_end(spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def saved(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint of a slim frame."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def small_side(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """The frame with a broadcast hint if it has at most so many rows, else None."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else None


def joined_by(left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """A join to a table with one row for each key: broadcast if it is small, else by key and salt.

    The salt comes from the column ``spread`` of ``left``, so that a key that holds a large
    share of its rows is dealt over many tasks.
    """
    right = saved(right)
    small = small_side(right)
    if small is not None:
        return left.join(small, on, how)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted.join(right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "__salt"], how).drop("__salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(frame: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add to each row, by name, the sum of an expression over all rows before it.

    ``order`` must be total. Rows are dealt out by ranges of it; each range sums up
    its own rows, and the totals of the ranges, one row for each partition, give
    every range its start. No task sees more than its range.
    """
    spark = frame.sparkSession
    n = partitions(spark)
    dealt = saved(
        frame.withColumns({f"__of_{k}": v for k, v in sums.items()})
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("__range", F.spark_partition_id())
    )
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("__range")
        .agg(*[F.sum(f"__of_{k}").alias(f"__sum_{k}") for k in sums])
        .select("__range", *[F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__start_{k}") for k in sums])
    )
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumns({f"__own_{k}": F.coalesce(F.sum(f"__of_{k}").over(own), F.lit(0)) for k in sums})
    joined = inside.join(F.broadcast(starts), "__range")  # at most a row for each partition
    return joined.select(*[F.col(c) for c in frame.columns if c not in sums], *[(F.col(f"__own_{k}") + F.col(f"__start_{k}")).alias(k) for k in sums])


def numbered(frame: DataFrame) -> DataFrame:
    """The frame with ``__nth``: 0 for the first of rows equal in all columns, 1 for the next, and so on.

    Rows whose hash is their own pass by. Equal rows are counted in parts and numbered from the
    counts, so that neither a hot row nor its numbers come together in one task.
    """
    whole = F.xxhash64(*frame.columns)
    again = saved(frame.groupBy(whole.alias("__row")).agg(F.count("*").alias("__n")).filter("__n > 1").select("__row"))
    small = small_side(again)
    if small is None:
        alone, equal = frame.limit(0), frame
    else:
        hashed = frame.withColumn("__row", whole)
        alone, equal = (hashed.join(small, "__row", how).drop("__row") for how in ("left_anti", "left_semi"))
    parts = equal.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).groupBy(*frame.columns, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*frame.columns).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    numbers = F.explode(F.sequence(F.col("__from"), F.col("__from") + F.col("__n") - 1)).alias("__nth")
    return alone.withColumn("__nth", F.lit(0).cast("long")).unionByName(placed.select(*frame.columns, numbers))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def before(values: Column, zero: int, combine: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """For an array of integers, an array that combines, at each place, all elements before it.

    Works in two levels, so that a long array costs its length times the block,
    not its length squared.
    """
    start = F.lit(zero).cast("int")

    def growing(some: Column) -> Column:
        return F.aggregate(some, F.array(start), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def placed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, start, combine))
        return let(growing(totals), lambda s: F.flatten(F.transform(blocks, lambda x, i: F.transform(F.slice(growing(x), F.lit(1), F.size(x)), lambda y: combine(F.get(s, i), y)))))

    def cut(v: Column) -> Column:
        count = F.ceil(F.size(v) / F.lit(block)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(v, b * block + 1, F.lit(block)))
        return F.when(F.size(v) > 0, let(blocks, placed)).otherwise(F.array().cast("array<int>"))

    return let(values, cut)


def sums_before(lengths: Column) -> Column:
    """For an array of integers, the array of the sums of all elements before each."""
    return before(lengths, 0, lambda a, x: a + x)


def pieces_between(text: Column, spans: Column, block: int = 1024) -> Column:
    """The stretches of a text that an array of (start, end) in code points names.

    The text is cut into blocks first, so that a stretch is not sought from the start of the text.
    """

    def piece(blocks: Column, span: Column) -> Column:
        first, last = F.floor(span["start"] / block).cast("int"), F.floor(span["end"] / block).cast("int")
        head = lambda n: F.substring(F.coalesce(F.get(blocks, first), F.lit("")), F.pmod(span["start"], F.lit(block)) + 1, n)
        middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.substring(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), F.pmod(span["end"], F.lit(block)))
        return F.when(first == last, head(span["end"] - span["start"])).otherwise(F.concat(head(F.lit(block)), middle, tail))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), lambda blocks: F.transform(spans, lambda span: piece(blocks, span)))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a keyed md5, the same in every engine and run."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
