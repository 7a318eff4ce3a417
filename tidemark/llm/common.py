"""Shared plumbing: tables, shared-folder materialisation and Arrow loops."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no shared folder; set it to one that the driver and all executors reach")
    if not _own_dir:  # one machine, as in tests: driver and executors are one process
        _own_dir.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _own_dir[0]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_scopes: list[list[str]] = []
_homes: set[str] = set()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside, but for those to keep, are deleted at the end."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def scratched(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on a DataFrame whose inner tables are deleted once its result is written."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        with scratch(docs.sparkSession):
            return materialize(operator(docs, *args, **kwargs), operator.__name__, keep=True)

    return run


def _home(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the driver ends."""
    home = f"{shared_dir(spark).rstrip('/')}/tidemark/{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)

        def clean() -> None:
            with contextlib.suppress(Exception):  # the session may have ended before
                _delete(spark, home)

        atexit.register(clean)
    return home


def materialize(df: DataFrame, label: str, keep: bool = False, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors.

    Inside scratch() the table lasts until its end, or with keep as long as the scope around that;
    without a scope around it, until the driver ends.
    """
    spark = df.sparkSession
    path = f"{_home(spark)}/{label}-{uuid.uuid4().hex}"
    scope = len(_scopes) - 1 - keep
    if scope >= 0:
        _scopes[scope].append(path)
    with byte_batches(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: About the bytes of a batch between Spark and a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """From now on the session gives Python workers batches of about so many bytes at most: for applications."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@contextlib.contextmanager
def byte_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What runs inside gives Python workers batches of about so many bytes at most."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    bound_batches(spark, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns: those given, with as many underscores before them as keep clear of df's columns."""
    there = {c.lower() for c in df.columns}
    lead = ""
    while any((lead + n).lower() in there for n in names):
        lead += "_"
    return [lead + n for n in names]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column written as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def arrow_rows(
    batches: Iterator[pa.RecordBatch],
    schema: pa.Schema,
    row: Callable[..., tuple | list[tuple] | None],
    at_most: int = 2048,
    at_most_bytes: int = 32 << 20,
) -> Iterator[pa.RecordBatch]:
    """Apply row(*columns) to each row in order; a tuple, a list of tuples or None comes back.

    Output leaves in batches of at most at_most rows (and about at_most_bytes of binary data).
    """
    out: list[tuple] = []
    size = 0
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for start in range(0, batch.num_rows, 512):
            lists = [c.slice(start, 512).to_pylist() for c in columns]
            for values in zip(*lists):
                made = row(*values)
                if made is None:
                    continue
                for one in [made] if isinstance(made, tuple) else made:
                    out.append(one)
                    size += sum(len(v) for v in one if isinstance(v, bytes | str))
                if len(out) >= at_most or size >= at_most_bytes:
                    yield to_batch(out, schema)
                    out, size = [], 0
    if out:
        yield to_batch(out, schema)


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]):
    """A worker process's one large object: kept from task to task, dropped when another operator needs its own."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Give freed memory back: a reused worker, or the driver, else keeps the most it ever held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[..., Iterator], keeps: object = None) -> Callable[..., Iterator]:
    """run over a task's batches, starting without another operator's large object and giving memory back at the end.

    keeps: the key under which run holds its own.
    """

    def of(batches: Iterator) -> Iterator:
        if any(k != keeps for k in _held):
            _held.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return of


def tidy_group(run: Callable[..., pa.Table], large: int = 4 << 20) -> Callable[..., pa.Table]:
    """run over one group; after a large one freed memory is given back."""

    def of(rows: pa.Table) -> pa.Table:
        _held.clear()
        size = rows.nbytes
        made = run(rows)
        del rows
        if size >= large:
            give_back()
        return made

    return of


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
