"""Versioned tables in a folder: immutable Parquet files and numbered commits that list them.

A table is a list of parts: files with rows, and files with keys whose rows in earlier parts are gone.
A commit adds parts to some tables and lists all, so its cost is that of what changes; ``compact`` turns
the parts of a table into one.

A commit is a small JSON file made whole and then renamed to its number through Hadoop's file
system, by whoever has created the number's claim.  A writer holds the store by a lock file.  Both rest on files
that only one can create, which local and HDFS folders have and object stores do not, so others are
refused.  Readers resolve one commit and keep its list: that is their snapshot.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Busy, Collision, Corrupt, Invalid
from ..functions.address import FIELDS, address_error, record_key

#: File systems on which creating a file that is there fails for all but one.
EXCLUSIVE = ("file", "hdfs", "viewfs")


class _Files:
    """The few file operations that commits need, on the file systems that can create a file once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)
        scheme = self.fs.getUri().getScheme()
        if scheme not in EXCLUSIVE:
            raise Invalid(f"{scheme}: two writers could both create a commit there")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def claim(self, name: str) -> bool:
        """Create an empty file; false if it is there."""
        target = self.path(name)
        self.fs.mkdirs(target.getParent())
        if self.fs.getUri().getScheme() == "file":  # the local file system of Hadoop looks first and creates then
            return bool(self.jvm.java.io.File(target.toUri().getPath()).createNewFile())
        try:
            return bool(self.fs.createNewFile(target))
        except Exception:
            if self.fs.exists(target):
                return False
            raise

    def publish(self, name: str, text: str) -> None:
        """A whole file under a name that has been claimed."""
        draft = self.path(f"drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.path(name).getParent())
        if not self.fs.rename(draft, self.path(name)):
            raise Corrupt(f"{name} could not be written")

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Reader:
    """The tables of one commit."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.files = spark, _Files(spark, root)
        known = self.versions()
        self.version = version if version is not None else max(known, default=0)
        self.tables: dict[str, list[dict]] = {}
        if self.version:
            if self.version not in known:
                raise Corrupt(f"commit {self.version} is gone")
            self.tables = json.loads(self.files.read(f"commits/{self.version:012d}.json"))

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("commits") if n.endswith(".json")]

    def _read(self, places: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.files.root}/{p}" for p in places])

    def table(self, name: str) -> DataFrame | None:
        """The rows of a table in this commit; None if it was never written."""
        parts = self.tables.get(name)
        if not parts:
            return None
        gone = [(k, p) for k, p in enumerate(parts) if p["kind"] == "gone"]
        if not gone:
            return self._read([p["place"] for p in parts])
        keys = gone[0][1]["keys"]
        # between two removals the files are one; a row stays if no later removal names it
        rows, run = [], []
        for k, part in enumerate([*parts, {"kind": "gone"}]):
            if part["kind"] == "rows":
                run.append(part["place"])
            elif run:
                rows.append(self._read(run).withColumn("_part", F.lit(k)))
                run = []
        dropped = reduce(DataFrame.unionByName, [self._read([p["place"]]).select(*keys).withColumn("_gone", F.lit(k)) for k, p in gone])
        dropped = dropped.groupBy(*keys).agg(F.max("_gone").alias("_gone"))
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
        return every.join(dropped, keys, "left").where("_gone is null or _gone < _part").select(*[c for c in every.columns if c != "_part"])

    def lookup(self, name: str, requests: DataFrame, keys: Iterable[str] = FIELDS) -> DataFrame:
        """Requests with the record of the very same address; a foreign record under the same key is a miss."""
        rows = self.table(name)
        keys = list(keys)
        return requests.join(rows, keys, "left") if rows is not None else requests.withColumn("key", F.lit(None).cast("bigint"))

    def described(self, name: str, asked: DataFrame, but: Iterable[str], keys: Iterable[str] = FIELDS) -> DataFrame | None:
        """The asked records without their payload columns, which are not read from the files."""
        rows = self.table(name)
        return None if rows is None else rows.drop(*but).join(asked.select(*keys), list(keys), "left_semi")


class Writer(Reader):
    """The single writer; use as a context."""

    def __enter__(self) -> Writer:
        if not self.files.claim("LOCK"):
            raise Busy(self.files.root)
        self.token = uuid.uuid4().hex
        self.files.publish(f"holders/{self.token}", "")
        Reader.__init__(self, self.spark, self.files.root)
        return self

    def __exit__(self, *_) -> None:
        if self.token in self.files.names("holders"):
            self.files.delete(f"holders/{self.token}")
            self.files.delete("LOCK")

    def break_lock(self) -> None:
        """Release a store whose writer has died; only for whoever knows that it has."""
        for name in ("LOCK", "holders", "claims"):
            self.files.delete(name)

    def write(self, rows: DataFrame, name: str) -> str:
        """New files of some rows, which no commit lists yet."""
        place = f"data/{name}-{uuid.uuid4().hex}"
        rows.write.mode("error").parquet(f"{self.files.root}/{place}")
        return place

    def _publish(self, parts: dict[str, list[dict]]) -> int:
        version = self.version + 1
        if not self.files.claim(f"claims/{version:012d}"):
            raise Busy(f"commit {version} is another writer's")
        listed = self.tables | parts
        self.files.publish(f"commits/{version:012d}.json", json.dumps(listed))
        self.version, self.tables = version, listed
        return version

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Publish new contents of some tables together; the others stay."""
        return self._publish({n: [{"kind": "rows", "place": self.write(rows, n)}] for n, rows in tables.items()})

    def append(self, tables: dict[str, DataFrame]) -> int:
        """Publish more rows of some tables together."""
        return self._publish({n: [*self.tables.get(n, []), {"kind": "rows", "place": self.write(rows, n)}] for n, rows in tables.items()})

    def compact(self, name: str) -> int:
        """The same table in one part."""
        return self.commit({name: self.table(name)})

    def upsert(self, name: str, rows: DataFrame, check: bool = True) -> int:
        """Insert or replace records by address, all or none.  ``rows`` have the address fields and a payload.

        The rows are written once, and what is checked is what was written.
        """
        place = self.write(with_key(rows), name)
        new, old = self._read([place]), self.table(name)
        if check:
            try:
                self.refuse(new, old)
            except (Invalid, Collision):
                self.files.delete(place)
                raise
        parts = list(self.tables.get(name, []))
        if old is not None:
            replaced = new.select(*FIELDS).join(old.select(*FIELDS), list(FIELDS), "left_semi")
            parts += self._gone(name, replaced)
        return self._publish({name: [*parts, {"kind": "rows", "place": place}]})

    def _gone(self, name: str, addresses: DataFrame, keys: Iterable[str] = FIELDS) -> list[dict]:
        """A part that says which rows are gone; none if there are no such rows."""
        place = self.write(addresses.select(*keys).distinct(), f"{name}-gone")
        if self._read([place]).isEmpty():
            self.files.delete(place)
            return []
        return [{"kind": "gone", "place": place, "keys": list(keys)}]

    def remove(self, names: Iterable[str], addresses: DataFrame, keys: Iterable[str] = FIELDS) -> int:
        """Delete records by address from one or more tables in one commit."""
        keys = list(keys)
        parts = {}
        for name in names:
            old = self.table(name)
            if old is not None:
                parts[name] = [*self.tables[name], *self._gone(name, addresses.select(*keys).join(old.select(*keys), keys, "left_semi"), keys)]
        return self._publish(parts)

    def refuse(self, rows: DataFrame, old: DataFrame | None) -> None:
        """Raise what the batch breaks: an address, a repeated record, or a key that another address has."""
        found = problems(rows, old).groupBy("error_class").count().collect()  # two rows at most for each class
        kinds = {r["error_class"] for r in found}
        for kind, error in (("Invalid", Invalid), ("Collision", Collision)):
            if kind in kinds:
                raise error("the batch was refused as a whole")

    def vacuum(self, keep: int = 2) -> list[int]:
        """Drop older commits and files that no kept one lists; readers of a dropped one must start anew."""
        versions = self.versions()
        gone, kept = versions[:-keep], versions[-keep:]
        live = {p["place"] for v in kept for parts in json.loads(self.files.read(f"commits/{v:012d}.json")).values() for p in parts}
        for v in gone:
            self.files.delete(f"commits/{v:012d}.json")
            self.files.delete(f"claims/{v:012d}")
        for n in self.files.names("data"):
            if f"data/{n}" not in live:
                self.files.delete(f"data/{n}")
        return gone


def with_key(rows: DataFrame) -> DataFrame:
    """Adds the numeric ``key`` of the address fields."""
    identity = F.struct(*[F.col(f) for f in FIELDS])
    return rows.withColumn("layer", F.col("layer").cast("bigint")).withColumn("key", record_key(identity))


def problems(rows: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """``(key, error_class)`` of a batch: bad addresses, repeats within it, and keys of other addresses."""
    identity = F.struct(*[F.col(f) for f in FIELDS])
    bad = rows.select("key", address_error(identity).alias("error_class")).where("error_class is not null")
    many = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(identity).alias("a"), F.max(identity).alias("b")).where("n > 1")
    many = many.select("key", F.when(F.col("a") == F.col("b"), "Invalid").otherwise("Collision").alias("error_class"))
    out = [bad, many]
    if old is not None:
        own = rows.select("key", identity.alias("a"))
        out.append(own.join(old.select("key", identity.alias("b")), "key").where("not (a <=> b)").select("key", F.lit("Collision").alias("error_class")))
    return reduce(DataFrame.unionByName, out)


def retry_once(read):
    """A read of a commit whose files were vacuumed meanwhile starts anew once, from the latest one."""
    from pyspark.errors import PySparkException

    try:
        return read()
    except (PySparkException, Corrupt):
        return read()
