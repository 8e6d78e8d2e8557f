"""Helpers that every training-data operator uses: table access, shared storage, token bytes."""

from __future__ import annotations

import ctypes
import functools
import itertools
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound, in bytes, of any table this package broadcasts.
MAX_BROADCAST_BYTES = 64 << 20


#: Rows of whole texts that go to Python at once.
ROWS_AT_ONCE = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset, a temporary one in local mode, where there is
    one machine, and an error on a cluster, whose executors share no temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    return shared_dir.own


#: Paths in the shared folder that outlive the call that wrote them.
_PLACES: list[str] = []
_SCOPE: ContextVar[Scope | None] = ContextVar("scope", default=None)


class Scope:
    """The tables of one call, in a folder of their own below the shared one, so that calls that run at once never see each other's.

    ``with Scope(...)`` makes it the place of every ``stored`` in the block (of this thread) and removes the folder at its end;
    what the block returns is written outside by ``settled``. Without ``with``, the folder stays until ``remove``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self._n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", itertools.count()

    def place(self, name: str) -> str:
        return f"{self.path}/{next(self._n)}-{name}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, self.place(name))

    @contextmanager
    def outside(self):
        """What is stored in this block stays when the scope goes."""
        token = _SCOPE.set(self._outer)
        try:
            yield
        finally:
            _SCOPE.reset(token)

    def settled(self, df: DataFrame, name: str) -> DataFrame:
        """df written outside this scope, where it stays, and read again."""
        with self.outside():
            return stored(df, name)

    def remove(self) -> None:
        _delete(self.spark, self.path)

    def __enter__(self) -> Scope:
        self._outer = _SCOPE.get()
        self._token = _SCOPE.set(self)
        return self

    def __exit__(self, *_) -> None:
        _SCOPE.reset(self._token)
        self.remove()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def place(spark: SparkSession, name: str) -> str:
    """A fresh path: in the scope that is entered, or in the shared folder itself."""
    if scope := _SCOPE.get():
        return scope.place(name)
    _PLACES.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _PLACES[-1]


def clean(spark: SparkSession, keep: int = 0) -> None:
    """Removes what this session has left in the shared folder (but for the first ``keep`` paths): call it when the results
    are written and no other call is running, for DataFrames that read from there fail afterwards."""
    while len(_PLACES) > keep:
        _delete(spark, _PLACES.pop())


def mark() -> int:
    return len(_PLACES)


#: A key with more rows than one in KEYS_SPLIT of all (and than ROWS_A_KEY) is split; so at most KEYS_SPLIT keys are.
KEYS_SPLIT, ROWS_A_KEY = 100_000, 2000


def join_spread(left: DataFrame, right: DataFrame, key: list[str], copies: str, spread: Column, how: str = "inner") -> DataFrame:
    """left joined with right, a stored table (it is read three times) with one row a key and, in ``copies``, the number of left's rows with that key.

    A hot key's rows are dealt over several tasks by a hash of ``spread``, and right's row is repeated for each of them. The
    list of hot keys is broadcast: it has at most KEYS_SPLIT rows, whatever the sizes.
    """
    total = right.agg(F.sum(copies)).first()[0] or 0
    most = max(ROWS_A_KEY, total // KEYS_SPLIT)
    salts = lambda c: F.ceil(c / F.lit(most))
    hot = right.where(F.col(copies) > most).select(*key, salts(F.col(copies)).alias("salts"))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("salts")), F.lit(0))).drop("salts")
    repeated = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(salts(F.col(copies)), F.lit(1)).cast("bigint") - 1))).drop(copies)
    return dealt.join(repeated, [*key, "salt"], how).drop("salt")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs no recomputation."""
    return _written(df, place(df.sparkSession, name))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_key(text: str = "text"):
    """A 128-bit key of a text's content: two independent 64-bit hashes."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.concat_ws("-", F.hex(F.xxhash64(t)), F.hex(F.xxhash64(F.lit(7919), t)))


def tidy(run):
    """Wraps what mapInArrow runs: when a task ends, its worker, which is kept for others, gives freed memory back."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return wrapped
