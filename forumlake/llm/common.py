"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlake.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, or it with underscores in front until no column has the name."""
    names = {t.lower() for t in taken}
    while wanted.lower() in names:
        wanted = f"_{wanted}"
    return wanted


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names; a dot in one is part of it."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def ascii_lower(text: Column) -> Column:
    """A to Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def discard(stored: DataFrame) -> None:
    """Delete a stage table behind its last use. Only whole tables in the shared folder go.

    What was computed from it must be stored by then: a lost executor's work is repeated
    from the tables that are left.
    """
    spark = stored.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in stored.inputFiles()}
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    shared = path_of(shared_dir(spark)).toUri().getPath()
    for folder in folders:
        path = path_of(folder)
        if path.getName().startswith("stage-") and path.getParent().toUri().getPath() == shared:
            path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Hand freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` on batches, after which its Python worker gives back what it has freed.

    An executor keeps more workers than it has cores if a stage has two Python steps, and all of
    them stay for the next tasks with the memory that they once needed.
    """

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


class Cache(dict):
    """Values by key, computed when first asked for; emptied to its base when full.

    The bound keeps a Python worker's memory level however many keys a task meets.
    """

    def __init__(self, compute, base=None, most: int = 200_000):
        super().__init__(base or {})
        self.compute, self.base, self.most = compute, base or {}, most + len(base or {})

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
            self.update(self.base)
        value = self[key] = self.compute(key)
        return value


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application.

    Python tasks import it by name. Where it is installed on the executors this changes
    nothing; elsewhere Spark's own file server hands them the archive.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp()) / "forumlake.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((root / "forumlake").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
