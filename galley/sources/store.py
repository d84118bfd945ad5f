"""A store of recipes by book: snapshots that readers see whole, and ids that stay."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def intern(stored: DataFrame, batch: DataFrame, bucket: Column | None = None) -> DataFrame:
    """stored (id, value) with an id for every value of the batch (value): known values keep theirs, new ones get the next
    numbers without a gap, by bucket and value. Nulls get none; repeated values one.

    New values are numbered within buckets (of a hash of the value, unless given), and each bucket starts where those before
    it end: only one count a bucket is gathered, never the values."""
    spark = stored.sparkSession
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.pmod(F.xxhash64("value"), F.lit(many)) if bucket is None else bucket
    new = batch.select("value").where("value is not null").distinct().join(stored.select("value"), "value", "left_anti").withColumn("bucket", at)
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("value"))
    counts = new.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a bucket
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    starts = counts.select("bucket", before.alias("before")).crossJoin(top)  # one row
    named = new.withColumn("place", place).join(starts, "bucket").select((F.col("top") + F.col("before") + F.col("place")).alias("id"), "value")
    return stored.select("id", "value").unionByName(named)


def shared(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one, spark.checkpoint.dir; of this machine only where all tasks run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-galley-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


class Snapshots:
    """Rows by book in a folder: each commit replaces whole books, and a reader sees all of a commit or nothing of it.

    Rows are dealt to buckets by their book. A commit writes the buckets it touches to a new folder, then a small file that
    says for every bucket which folder holds it; that file is made under another name and renamed last. Readers take the
    newest such file. A run that dies before the rename leaves the store as it was, and may be run again: a batch that the
    newest file names already is left out. Two commits at once cannot both take the next number: the later one fails.
    """

    def __init__(self, spark: SparkSession, root: str, book: str = "book", buckets: int = 64) -> None:
        self.spark, self.root, self.book, self.buckets = spark, root, book, buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _newest(self) -> tuple[int, dict]:
        at, fs = self._fs(f"{self.root}/commits")
        names = sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
        done = [n for n in names if n.endswith(".json")]
        if not done:
            return 0, {"batch": None, "folders": {}, "schema": None}
        text = self.spark.read.text(f"{self.root}/commits/{done[-1]}", wholetext=True).first()[0]
        return int(done[-1].removesuffix(".json")), json.loads(text)

    def _publish(self, number: int, state: dict) -> None:
        made, fs = self._fs(f"{self.root}/commits/_{uuid.uuid4().hex}")
        out = fs.create(made)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        last, _ = self._fs(f"{self.root}/commits/{number:09d}.json")
        if fs.exists(last) or not fs.rename(made, last):
            raise RuntimeError(f"commit {number} was made by another run")

    def read(self) -> DataFrame | None:
        """All rows of the newest commit; None before the first one."""
        _, state = self._newest()
        return self._rows(state, list(state["folders"])) if state["schema"] else None

    def _rows(self, state: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{state['folders'][b]}/bucket={b}" for b in buckets if b in state["folders"]]
        return self.spark.read.schema(state["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], state["schema"])

    def commit(self, batch: str, rows: DataFrame, gone: DataFrame | None = None) -> bool:
        """Replace all rows of the books in rows, and drop those in gone (a column of books). False if the batch is the
        newest commit already. Rows have the columns of the first commit; a null book is a book."""
        number, state = self._newest()
        if state["batch"] == batch:
            return False
        schema = state["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        names = rows.columns
        at = F.pmod(F.xxhash64(self.book), F.lit(self.buckets)).cast("int")
        books = rows.select(self.book).distinct()
        books = (books.union(gone.select(self.book)).distinct() if gone is not None else books).withColumn("bucket", at)
        touched = [str(r[0]) for r in books.select("bucket").distinct().collect()]  # as many as there are buckets at most
        kept = self._rows(state | {"schema": schema}, touched).alias("old").join(books.select(F.col(self.book).alias("__book")), F.col(f"old.{self.book}").eqNullSafe(F.col("__book")), "left_anti")
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        new = kept.select(*names).unionByName(rows).withColumn("bucket", at)
        new.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        path, fs = self._fs(folder)
        written = {f.getPath().getName().removeprefix("bucket=") for f in fs.listStatus(path) if f.getPath().getName().startswith("bucket=")}
        folders = {b: f for b, f in state["folders"].items() if b not in touched} | {b: folder for b in touched if b in written}
        self._publish(number + 1, {"batch": batch, "folders": folders, "schema": schema})
        return True
