"""Bucketed tables that change together, by commits that either happen whole or not at all.

A table is a number of buckets, each a folder of Parquet files that is never written twice. A commit is one small JSON
file that names the folder of every bucket of every table, its parent and a few facts. Its number follows the parent's,
and a file is created only where none of that name is there, so of two writers who started from one state only one
can commit (compare and swap). A writer that dies before it leaves folders that no commit names, and no other trace.
Buckets that a commit doesn't touch keep their folders.

Commit files are renamed into place without overwriting, as Spark's own streaming logs are.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit came first, or the state isn't the one that was expected."""


@dataclass(frozen=True)
class State:
    version: int = 0
    facts: dict = field(default_factory=dict)
    #: Of each table: its schema as JSON, number of buckets, and the folder of each bucket that has rows.
    tables: dict = field(default_factory=dict)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def table_digest(rows: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order: counts and sums of parts of their hashes."""
    row = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return rows.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), part(1), part(16), part(31), part(46)), 256)).first()[0]


class Versioned:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commit_file(self, version: int) -> str:
        return f"{self.root}/commits/{version:012d}.json"

    def state(self, version: int | None = None) -> State:
        """The last commit, or a given one; version 0 is the empty start."""
        folder = self._path(f"{self.root}/commits")
        if version is None:
            files = self._store.listStatus(folder) if self._store.exists(folder) else []
            version = max((int(f.getPath().getName().split(".")[0]) for f in files if f.getPath().getName().endswith(".json")), default=0)
        if version == 0:
            return State()
        stream = self._store.open(self._path(self._commit_file(version)))
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return State(**json.loads(text))

    def read(self, name: str, state: State | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """A table, or some of its buckets; None where the state has no such table."""
        state = state or self.state()
        if name not in state.tables:
            return None
        table = state.tables[name]
        schema = StructType.fromJson(json.loads(table["schema"]))
        folders = [f for b, f in table["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def stage(self, name: str, rows: DataFrame, key: str, state: State, buckets: int = 16, only: list[int] | None = None) -> dict:
        """Write the given buckets of a table (all without ``only``) from rows, and return the table as a commit names it.

        rows hold these buckets' rows, and no others. A table keeps the number of buckets it started with."""
        known = state.tables.get(name)
        buckets = known["buckets"] if known else buckets
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("__bucket", bucket_of(F.col(key), buckets))
        dealt.repartition(buckets, "__bucket").write.partitionBy("__bucket").parquet(folder)
        kept = {b: f for b, f in (known["folders"] if known else {}).items() if only is not None and int(b) not in only}
        written = {p.getPath().getName().split("=")[1]: f"{folder}/{p.getPath().getName()}" for p in self._store.listStatus(self._path(folder)) if "=" in p.getPath().getName()}
        if only is not None and (other := {int(b) for b in written} - set(only)):
            raise ValueError(f"rows of buckets {sorted(other)} were not to be written")
        return {"schema": rows.schema.json(), "buckets": buckets, "folders": kept | written}

    def commit(self, state: State, tables: dict, facts: dict) -> State:
        """The state after ``state``, with these tables and facts in place of theirs; Conflict if another has come first."""
        new = State(state.version + 1, {**state.facts, **facts}, {**state.tables, **tables})
        path = self._path(self._commit_file(new.version))
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}.json")
        text = json.dumps({"version": new.version, "facts": new.facts, "tables": new.tables}).encode()
        if new.version != self.state().version + 1:
            raise Conflict(f"the state is no longer version {state.version}")
        self._store.mkdirs(path.getParent())
        # The whole content is written first; taking the name, without overwriting, is what can happen only once.
        stream = self._store.create(draft, False)
        stream.write(bytearray(text))
        stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(self._store.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, path, none)
        except Py4JJavaError as e:
            raise Conflict(f"version {new.version} was committed by another") from e
        return new

