"""A sample that stays: every identifier keeps the random number of its first sight.

The store is an append-only table (id, u, batch) in the shared folder. A feed's
new ids are those an anti-join doesn't find in the store; they get a uniform
number and are appended. The sample is every id whose number lies below a
threshold that never falls, so nothing once chosen is lost.
"""

from __future__ import annotations

import itertools
import re
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.functions.keys import uniform_key
from cellframe.operators.skew import heavy_keys, salted_join
from cellframe.runtime import Scratch, delete, shared_folder

SCHEMA = "id long, u double, batch long"
#: A commit names the folder of numbers that it makes part of the store, and the batch.
COMMIT = re.compile(r"commit-(\d+)")


class NumberStore:
    """Permanent random numbers under a path all executors share; it outlives the session that writes it.

    A feed's numbers are written to a folder of their own, which no reader looks
    at. One rename of a small finished file to commit-N, with N the number of
    commits so far, makes them part of the store: of two writers only one gets N,
    the other becomes N + 1. If both have a number for an id, that of the earlier
    commit counts, so a number once read is never replaced. What a lost writer
    leaves behind is no part of the store.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, seed: int = 0):
        self.spark, self.seed = spark, seed
        self.path = path.rstrip("/") if path else Scratch(spark, "numbers").root

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(self._path())] if fs.exists(self._path()) else []

    def batches(self) -> list[tuple[int, str]]:
        """Batch and folder of each commit, in the order in which their numbers count."""
        order = sorted(int(m[1]) for n in self._names() if (m := COMMIT.fullmatch(n)))
        if not order:
            return []
        texts = self.spark.read.text([f"{self.path}/commit-{n}" for n in order]).select("value", F.regexp_extract(F.input_file_name(), r"commit-(\d+)$", 1).cast("long").alias("n"))
        return [(int(batch), folder) for _, batch, folder in sorted((r.n, *r.value.split(" ")) for r in texts.collect())]  # one small row a commit

    def read(self) -> DataFrame:
        """id, u, batch: one row an id, with the number of the earliest commit that has it."""
        parts = [self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{folder}").withColumn("__order", F.lit(i)) for i, (_, folder) in enumerate(self.batches())]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        if len(parts) == 1:
            return parts[0].drop("__order")
        return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.min_by(F.struct("u", "batch"), "__order").alias("first")).select("id", "first.u", "first.batch")

    def insert(self, ids: DataFrame, batch: int | None = None) -> None:
        """Numbers for the ids (column id) that the store doesn't have. Null ids get none.

        Batches only add: an insert under a number that is taken adds a further
        part to that batch, a repeated insert finds all its ids there and adds
        none. The number is drawn from a generator keyed by seed and id; it is
        the stored number that counts, whatever seed a later session gives.
        """
        done = self.batches()
        batch = max((b for b, _ in done), default=-1) + 1 if batch is None else batch
        new = ids.select(F.col("id").cast("long").alias("id")).where(F.col("id").isNotNull()).distinct()
        if done:
            new = new.join(self.read().select("id"), "id", "left_anti")
        writer = uuid.uuid4().hex[:12]
        new.select("id", uniform_key(F.col("id"), self.seed).alias("u"), F.lit(batch).cast("long").alias("batch")).write.parquet(f"{self.path}/numbers-{writer}")
        self._commit(batch, f"numbers-{writer}")

    def _commit(self, batch: int, folder: str) -> None:
        jvm, fs = self.spark._jvm, self._fs()
        ready = self._path(f"ready-{folder}")
        out = fs.create(ready, True)
        out.write(bytearray(f"{batch} {folder}\n".encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # refuses a name that is taken
        for n in itertools.count(len([x for x in self._names() if COMMIT.fullmatch(x)])):
            try:
                return context.rename(ready, self._path(f"commit-{n}"), plain)
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise

    def threshold(self, share: float) -> float:
        """The share, or the largest one asked for before: the threshold never falls. It is kept beside the numbers."""
        if not 0.0 <= share <= 1.0:
            raise ValueError("share must lie in [0, 1]")
        held = [float(n.split("=")[1]) for n in self._names() if n.startswith("share=")]
        now = max([share, *held])
        if now not in held:
            self._fs().mkdirs(self._path(f"share={now!r}"))
        return now

    def chosen(self, share: float) -> DataFrame:
        return self.read().where(F.col("u") < self.threshold(share)).select("id", "u")

    def forget(self) -> None:
        """Deletes the store, with all its numbers."""
        delete(self.spark, self.path)


def lasting_store(spark: SparkSession, name: str, seed: int = 0) -> NumberStore:
    """A store of that name in the shared folder; unlike scratch tables it is not deleted at exit."""
    return NumberStore(spark, f"{shared_folder(spark)}/stores/{name}", seed)


def stable_sample(df: DataFrame, share: float, feeds: list | None = None, store: NumberStore | None = None, seed: int = 0) -> DataFrame:
    """All rows of the sampled ids, with the id's number `u`.

    `feeds` are conditions that split df into the order of arrival; each is
    inserted into the store in turn (one feed if none are given). An id is in or
    out with all its rows. Rows with a null id are never sampled. share 0 gives
    no rows, share 1 all rows with an id; an empty table gives no rows. A column
    of df named u is replaced. Without a store the numbers live for this session.
    """
    store = store or NumberStore(df.sparkSession, seed=seed)
    scratch = Scratch(df.sparkSession, "sample")
    rows = df.where(F.col("id").isNotNull())
    parts = []
    for i, feed in enumerate(feeds or [F.lit(True)]):
        ids = scratch.save(rows.where(feed).groupBy(F.col("id").cast("long").alias("id")).count(), f"ids{i}")
        store.insert(ids)
        parts.append(ids)
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    counts = counts.groupBy("id").agg(F.sum("count").alias("count")) if len(parts) > 1 else counts
    total = counts.agg(F.sum("count")).first()[0] or 0
    return salted_join(rows.drop("u"), store.chosen(share), "id", heavy_keys(counts, "id", "count", total))
