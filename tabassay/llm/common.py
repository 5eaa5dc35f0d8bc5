"""What several operators of this folder need: stored tables, gapless numbers, let-bindings."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of other characters than these, for every operator that has words.
SPACES = r"[\x20\x09-\x0D]+"


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: `spark.checkpoint.dir`, or a temporary one on a purely local session.

    The setting belongs to the application and cannot be changed later, so a temporary folder is remembered here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _folders.get(spark.sparkContext.applicationId)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _folders[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tabassay-")
    return folder


#: Names of the folders that `stored` has written; `dropped` deletes no other.
_written: set[str] = set()


def stored(df: DataFrame, name: str, by: str | None = None, compression: str = "gzip") -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: lineage ends there and survives lost executors.

    `by` names a column of few values whose rows go to folders of their own.
    """
    name = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}"
    _written.add(name)
    writer = df.write.option("compression", compression)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete what `stored` wrote, once nothing reads it any more: all that was made from it is stored itself."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        context = spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(files[0])
        while folder is not None and folder.getName() not in _written:
            folder = folder.getParent()
        if folder is not None:
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside are deleted as soon as it is written, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, later ones too; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="tabassay-")) / f"{package.name}.zip"
    with zipfile.ZipFile(name, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    context.addPyFile(str(name))
    _shipped.add(context.applicationId)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once per row, also where `use` refers to it inside a lambda."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def bounded_sample(df: DataFrame, limit: int) -> DataFrame:
    """All rows if there are at most `limit`, else about nine tenths of `limit` at random, never more than `limit`."""
    n = df.count()
    return df if n <= limit else df.sample(0.9 * limit / n, seed=17).limit(limit)


def numbered(df: DataFrame, keys: list[str], to: str) -> DataFrame:
    """Add `to`: 0, 1, 2 ... without gaps within each key, in no stated order.

    `df` must be a stored table whose column `uid` is unique. Rows of a key are dealt to cells by
    their uid; the counts of the cells give each cell its first number. So no key, however
    frequent, meets in one task: that sees a key's cells at most, as many as shuffle partitions.
    """
    cell = F.pmod(F.xxhash64("uid"), F.lit(shuffle_partitions(df.sparkSession))).alias("_cell")
    dealt = df.select("*", cell)
    cells = dealt.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("uid")) - 1
    return (
        dealt.withColumn("_row", row)
        .join(cells, [*keys, "_cell"])
        .withColumn(to, F.col("_before") + F.col("_row"))
        .drop("_cell", "_before", "_row")
    )


def prefix_sums(numbers: Column, block: int = 256) -> Column:
    """For an array of longs: the sum of all earlier elements, for each. Blocks keep the work near linear."""
    zero = F.lit(0).cast("long")

    def within(part: Column) -> Column:
        """Running sums of one block; the last is the block's total."""
        return F.aggregate(part, F.array(zero), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))

    def joined(parts: Column) -> Column:
        firsts = within(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(
            firsts,
            lambda f: F.flatten(
                F.transform(parts, lambda p, i: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + F.get(f, i)))
            ),
        )

    def blocks(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / block).cast("int"))
        return let(F.transform(starts, lambda b: within(F.slice(all_, b * block + 1, block))), joined)

    empty = F.array().cast("array<long>")
    return let(numbers, lambda a: F.when(F.size(a) == 0, empty).otherwise(blocks(a)))
