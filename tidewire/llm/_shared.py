"""Where intermediate results go, and small pieces used by several operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import release as release

#: Fixed value: a word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: `spark.checkpoint.dir`, or one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_dir.get() if set_dir.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder with checkpoint(), so that a lost executor costs nothing before it."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back (column-pruned reads, known size).

    The table stays until the innermost `workspace` around the call ends, without one for as long as the folder does.
    """
    return _kept(df.sparkSession).store(df)


def bucketed(df: DataFrame, *by: str) -> DataFrame:
    """`df` stored as a table bucketed by columns, for as long as a `stored` one: joins and groups on them leave it where it is."""
    return _kept(df.sparkSession).bucketed(df, *by)


def _kept(spark: SparkSession) -> Scratch:
    scratch = Scratch(spark)
    if _open_workspaces:
        _open_workspaces[-1].append(scratch)
    return scratch


_open_workspaces: list[list[Scratch]] = []


@contextmanager
def workspace() -> Iterator[None]:
    """Deletes, at its end, every table that was `stored` or `bucketed` inside: for callers that write the result out before they leave."""
    _open_workspaces.append([])
    try:
        yield
    finally:
        for scratch in _open_workspaces.pop():
            scratch.clear()


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder through Spark's file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables in the shared folder that only one computation needs; `clear` deletes them when its result is stored elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n, self.names = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0, []

    def store(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, *by: str) -> DataFrame:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.n += 1
        self.names.append(f"bucketed_{uuid.uuid4().hex}")
        df.write.option("compression", "zstd").bucketBy(n, *by).option("path", f"{self.folder}/{self.n}").saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def clear(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running(values: Column, join: Callable[[Column, Column], Column] | None = None, back: bool = False) -> Column:
    """Running sums of an array (or what `join` makes of an element and those before it, null where there is none; `back`: after it).

    In each of log2(n) steps every element takes in the one 1, 2, 4, ... places away, so the work is n log n and nothing is
    carried from element to element.
    """
    join = join or (lambda x, y: x + F.coalesce(y, F.lit(0).cast("long")))
    n = F.size(values)
    steps = F.when(n > 1, F.sequence(F.lit(0), F.length(F.bin(n - 1)) - 1)).otherwise(F.array().cast("array<int>"))

    def step(a, k):
        far = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(a, lambda x, i: join(x, F.get(a, i + far if back else i - far)))

    return F.aggregate(steps, values, step)


#: Code points of a chunk.
CHUNK = 4096


def chunks(text: Column) -> Column:
    """A text in pieces of CHUNK code points, so that `between` need not count from its beginning."""
    return F.when(F.length(text) > CHUNK, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(F.array(text))


def between(pieces: Column, begin: Column, end: Column) -> Column:
    """Code points `begin` to `end` of the text that `chunks` took apart."""
    a, b = (F.floor(x / CHUNK).cast("int") for x in (begin, end))

    def part(i, first, size):
        return F.coalesce(F.substring(F.get(pieces, i), first.cast("int"), size.cast("int")), F.lit(""))

    inside = part(a, begin - a * CHUNK + 1, end - begin)
    across = F.concat(part(a, begin - a * CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), part(b, F.lit(1), end - b * CHUNK))
    return F.when(begin >= end, F.lit("")).when(a == b, inside).otherwise(across)


def n_words(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that do not clash with any column of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
