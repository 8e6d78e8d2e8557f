"""Several tables published as one: written aside, audited, and made current by one pointer.

A publication is a folder of versions (v=<n>/<table>) and of manifests (manifest/<n>.json). Readers follow the manifest with the highest number, so they stay on
the old version until the new manifest is there; the manifest is created, never overwritten, which is the compare-and-set: of two writers
that started from one version the second fails. A probe that fails leaves every table as it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

Probe = Callable[[dict[str, DataFrame]], str | None]


class Conflict(Exception):
    """Another writer has published since this one started."""


class Rejected(Exception):
    """Probes that failed; nothing was published."""


@dataclass(frozen=True)
class Staged:
    """Tables written below ``number``, not yet current; ``base`` is the version that they were made from."""

    number: int
    base: int | None
    tables: dict[str, DataFrame]


class Publication:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str, prefix: str, suffix: str = "") -> list[int]:
        path, fs = self._path(name)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removeprefix(prefix).removesuffix(suffix)) for n in names if n.startswith(prefix) and n.endswith(suffix) and n.removeprefix(prefix).removesuffix(suffix).isdigit())

    def current(self) -> int | None:
        return max(self._numbers("manifest", "", ".json"), default=None)

    def manifest(self, number: int | None = None) -> dict:
        number = self.current() if number is None else number
        if number is None:
            return {}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/manifest/{number}.json").collect()))

    def read(self, number: int | None = None) -> dict[str, DataFrame]:
        """The tables of the current version, or of a given one; none before the first."""
        said = self.manifest(number)
        return {t: self.spark.read.schema(x["schema"]).parquet(f"{self.folder}/v={x['version']}/{t}") for t, x in said.get("tables", {}).items()}

    def stage(self, tables: dict[str, DataFrame]) -> Staged:
        """Writes the tables that change under a number of their own; the others stay those of the current version."""
        base = self.current()
        number = max([base or 0, *self._numbers("", "v=")], default=0) + 1
        while True:  # a number is taken by making its folder
            path, fs = self._path(f"v={number}/_taken")
            fs.mkdirs(path.getParent())
            try:
                fs.create(path, False).close()
                break
            except Exception as e:  # py4j's error has the class of the JVM's
                if "FileAlreadyExists" not in str(e):
                    raise
                number += 1
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/v={number}/{name}")
        written = {name: self.spark.read.schema(df.schema).parquet(f"{self.folder}/v={number}/{name}") for name, df in tables.items()}
        return Staged(number, base, written)

    def publish(self, staged: Staged, probes: dict[str, Probe]) -> int:
        """Runs every probe on the tables as they would be and swaps the pointer. A probe gives None, or what is wrong."""
        before = self.manifest(staged.base) if staged.base is not None else {}
        whole = self.read(staged.base) | staged.tables if staged.base is not None else dict(staged.tables)
        wrong = {name: said for name, probe in probes.items() if (said := probe(whole))}
        if wrong:
            raise Rejected("; ".join(f"{n}: {w}" for n, w in sorted(wrong.items())))
        if self.current() != staged.base:
            raise Conflict(f"version {self.current()} is current, not {staged.base}")
        number = (staged.base or 0) + 1
        kept = before.get("tables", {})
        mine = {name: {"version": staged.number, "rows": df.count(), "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)} for name, df in staged.tables.items()}
        body = json.dumps({"number": number, "base": staged.base, "tables": kept | mine}, sort_keys=True)
        path, fs = self._path(f"manifest/{number}.json")
        fs.mkdirs(path.getParent())
        draft, _ = self._path(f"manifest/_{number}-{staged.number}")
        out = fs.create(draft, True)
        out.write(body.encode())
        out.close()
        try:
            # a rename onto a file that is there fails on a file system with atomic renames
            if fs.exists(path) or not fs.rename(draft, path):
                raise Conflict(f"version {number} was published meanwhile")
        finally:
            fs.delete(draft, False)
        return number


# ---- probes -----------------------------------------------------------------------------------------------------------------


def unique(table: str, *keys: str) -> Probe:
    def probe(t: dict[str, DataFrame]) -> str | None:
        twice = t[table].groupBy(*keys).count().where("count > 1").limit(1).collect()
        return f"{table}: {twice[0].asDict()}" if twice else None

    return probe


def references(table: str, key: str, parent: str, parent_key: str) -> Probe:
    """Every key that is not blank has its parent."""

    def probe(t: dict[str, DataFrame]) -> str | None:
        parents = t[parent].select(F.col(parent_key).alias(key))
        lost = t[table].where(T.blank(key) != "").join(parents, key, "left_anti").select(key).limit(1).collect()
        return f"{table}.{key}: no {parent} {lost[0][0]!r}" if lost else None

    return probe


def holds(table: str, test: Column, what: str) -> Probe:
    """No row for which the test is not true."""

    def probe(t: dict[str, DataFrame]) -> str | None:
        n = t[table].where(~F.coalesce(test, F.lit(False))).count()
        return f"{table}: {n} rows without {what}" if n else None

    return probe


def at_least(table: str, rows: int) -> Probe:
    def probe(t: dict[str, DataFrame]) -> str | None:
        n = t[table].count()
        return f"{table}: {n} rows, not {rows}" if n < rows else None

    return probe


def cascade(parent: str, key: str, children: dict[str, str]) -> Probe:
    """Taking any parent away with its children would leave no orphan behind: every child row finds its parent's row by the same key type, and the children of one parent are
    disjoint from those of all others."""

    def probe(t: dict[str, DataFrame]) -> str | None:
        kinds = {t[c].schema[fk].dataType for c, fk in children.items()} | {t[parent].schema[key].dataType}
        if len(kinds) > 1:
            return f"{parent}: keys of different types"
        for c, fk in children.items():
            if said := references(c, fk, parent, key)(t):
                return said
        return unique(parent, key)(t)

    return probe


def upsert(now: DataFrame, incoming: DataFrame, key: str, keep_if_blank: tuple[str, ...] = ()) -> DataFrame:
    """The whole table after incoming rows (one a key) took the place of rows with their key; columns of ``keep_if_blank`` keep their old value where the new one is blank."""
    both = now.alias("a").join(incoming.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    new = F.col(f"b.{key}").isNotNull()
    kept = lambda c: F.when(new & (T.blank(F.col(f"b.{c}")) == ""), F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))) if c in keep_if_blank else F.when(F.lit(False), F.col(f"a.{c}"))
    return both.select(*(F.coalesce(kept(c), F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))).alias(c) for c in now.columns))


def migrate(publication: Publication, plan: dict[str, tuple[DataFrame, str]], keep_if_blank: dict[str, tuple[str, ...]], probes: dict[str, Probe]) -> int:
    """A migration plan (table -> rows, key) as one publication: every table upserted, probed together, current at once."""
    now = publication.read()
    tables = {name: upsert(now[name], rows, key, keep_if_blank.get(name, ())) if name in now else rows for name, (rows, key) in plan.items()}
    return publication.publish(publication.stage(tables), probes)


def report(before: dict[str, DataFrame], plan: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, action, rows): what a plan creates, updates and leaves as it is."""
    out = None
    for name, (rows, key) in sorted(plan.items()):
        if name not in before:
            counted = rows.select(F.lit("create").alias("action"))
        else:
            columns = before[name].columns
            old = before[name].select(F.col(key).alias("_k"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("_h"))
            new = rows.select(F.col(key).alias("_k"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("_n"))
            counted = new.join(old, "_k", "left").select(F.when(F.col("_h").isNull(), "create").when(F.col("_h") == F.col("_n"), "unchanged").otherwise("update").alias("action"))
        one = counted.groupBy("action").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "action", "rows")
        out = one if out is None else out.unionByName(one)
    return out
