"""Tables of Parquet files that batches are merged into.

A table's rows are dealt by a hash of the key to a fixed number of parts. A batch rewrites the parts that its keys fall
into, into a folder of its own, and then puts a new manifest beside the last one, by one rename: it names the folder of
every part, so parts that the batch doesn't touch keep their files, and readers see all of a batch or nothing. The
manifest also remembers the last batch of each writer, and a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables

#: Manifests that are kept, so that readers of an older version find their files listed.
KEPT = 3

#: Takes the rows that are there and those that come. One that names the keys it works ``within`` may get both with their
#: ``part``, keeps it, and leaves the rows dealt by it.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class ConcurrentWrite(RuntimeError):
    """Another writer has put a manifest of the same version there first."""


class VersionedTable:
    """``schema`` and ``parts`` are those of the first batch; ``keys`` name the columns that a row is found by."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], parts: int = 64):
        self.spark, self.root, self.keys, self.parts = spark, root.rstrip("/"), keys, parts

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        fs, folder = self._fs(), self._path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """``version, parts`` (part to folder), ``batches`` (writer to its last batch) and ``schema``."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "parts": {}, "batches": {}, "schema": None, "n_parts": self.parts}
        data = self._fs().open(self._path(f"{self.root}/manifests/{version or versions[-1]}.json"))
        try:
            return json.loads(bytes(data.readAllBytes()).decode())
        finally:
            data.close()

    def _publish(self, manifest: dict) -> None:
        fs = self._fs()
        draft, final = (self._path(f"{self.root}/manifests/{n}") for n in (f".draft-{manifest['folder']}", f"{manifest['version']}.json"))
        out = fs.create(draft, True)
        try:
            out.write(json.dumps(manifest, sort_keys=True).encode())
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise ConcurrentWrite(f"version {manifest['version']} of {self.root} is there already")
        for v in self._versions()[:-KEPT]:
            fs.delete(self._path(f"{self.root}/manifests/{v}.json"), False)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys)), F.lit(self.parts))

    def _read(self, manifest: dict, parts: list[str], schema) -> DataFrame:
        folders = [f"{self.root}/{manifest['parts'][p]}" for p in parts if p in manifest["parts"]]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of the newest version or of one that is kept."""
        from pyspark.sql.types import StructType

        manifest = self.manifest(version)
        if not manifest["schema"]:
            raise ValueError(f"{self.root} has no rows yet")
        return self._read(manifest, sorted(manifest["parts"]), StructType.fromJson(manifest["schema"]))

    def last_batch(self, writer: str) -> int:
        """The number of the last batch that the writer has merged, or -1."""
        return self.manifest()["batches"].get(writer, -1)

    def touched(self, incoming: DataFrame) -> DataFrame:
        """The rows of the parts that the keys of ``incoming`` fall into; none while the table has no rows."""
        from pyspark.sql.types import StructType

        manifest = self.manifest()
        if not manifest["schema"]:
            return incoming.limit(0)
        return self._read(manifest, self._parts_of(incoming), StructType.fromJson(manifest["schema"]))

    def _parts_of(self, rows: DataFrame) -> list[str]:
        return [str(r[0]) for r in rows.select(self._part().alias("p")).distinct().collect()]  # as many as there are parts at most

    def merge(self, incoming: DataFrame, how: Merge, writer: str, batch: int, schema=None) -> bool:
        """Replace the touched parts by ``how(current rows, incoming rows)``; False if the writer has merged this batch or a
        later one before. ``schema`` is the table's, if it isn't that of the incoming rows."""
        from pyspark.sql.types import StructType

        manifest = self.manifest()
        if batch <= manifest["batches"].get(writer, -1):
            return False
        if manifest["n_parts"] != self.parts:
            raise ValueError(f"the table has {manifest['n_parts']} parts, not {self.parts}")
        schema = StructType.fromJson(manifest["schema"]) if manifest["schema"] else schema or incoming.schema
        touched = self._parts_of(incoming)
        folder = f"batches/{writer}-{batch}"
        have, dealt = self._read(manifest, touched, schema), lambda df: df.withColumn("part", self._part())
        if set(getattr(how, "within", ())) == set(self.keys):
            after = how(dealt(have), dealt(incoming)).select(*schema.names, "part")
        else:
            after = dealt(how(have, incoming).select(*schema.names)).repartition("part")
        after.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/{folder}")
        fs = self._fs()
        parts = {p: f for p, f in manifest["parts"].items() if p not in touched}
        parts |= {p: f"{folder}/part={p}" for p in touched if fs.exists(self._path(f"{self.root}/{folder}/part={p}"))}
        self._publish({"version": manifest["version"] + 1, "parts": parts, "batches": manifest["batches"] | {writer: batch}, "schema": json.loads(schema.json()), "n_parts": self.parts, "folder": folder.replace("/", "-")})
        return True

    def follow(self, stream: DataFrame, how: Merge, writer: str, checkpoint: str, schema=None, **trigger):
        """Merge every micro-batch of a stream; a batch that is repeated after a failure changes nothing."""
        return stream.writeStream.foreachBatch(lambda df, batch: self.merge(df, how, writer, batch, schema) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _marked(have: DataFrame, new: DataFrame) -> DataFrame:
    """All rows, ``__new`` or not; rows with a ``part`` are dealt by it once, for the merge and for the write that follows."""
    both = have.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.repartition("part") if "part" in both.columns else both


def _within(df: DataFrame, keys: list[str]) -> list[str]:
    return ["part", *keys] if "part" in df.columns else keys


def inserts(keys: list[str], order: list[str]) -> Merge:
    """Rows whose key is new; the first of each. A key with a null is always new."""

    def merge(have: DataFrame, new: DataFrame) -> DataFrame:
        both = _marked(have, new)
        key = Window.partitionBy(*_within(both, keys))
        some = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
        rows = both.withColumn("__n", F.row_number().over(key.orderBy("__new", *order))).withColumn("__old", F.count(F.when(F.col("__new") == 0, 1)).over(key))
        first = (F.col("__n") == F.col("__old") + 1) & (some | (F.col("__old") == 0))
        return rows.where((F.col("__new") == 0) | first).drop("__new", "__n", "__old")

    merge.within = keys
    return merge


def upserts(keys: list[str], order: list[str]) -> Merge:
    """The newest row of each key of the batch takes the place of the table's."""
    return lambda have, new: tables.upsert(have, new, keys, order)


def refreshes(keys: list[str], order: list[str], seen: str) -> Merge:
    """Rows that are there stay, and so does the first of each new key; ``seen`` becomes the latest of all."""

    def merge(have: DataFrame, new: DataFrame) -> DataFrame:
        both = _marked(have, new)
        own = _within(both, keys)
        rest = [c for c in have.columns if c not in (*own, seen)]
        return both.groupBy(*own).agg(F.min_by(F.struct(*rest), F.struct("__new", *order)).alias("row"), F.max(seen).alias(seen)).select(*own, "row.*", seen)

    merge.within = keys
    return merge


#: Columns of the table that ``cases`` keeps, besides its key.
CASE_COLUMNS = ("severity_last", "severity_rank_peak", "status", "chain", "protocol")


def cases(key: str, order: list[str]) -> Merge:
    """Changes of several kinds by ``tables.upsert_by_policy``: what the table has of a case comes first, as an incident."""

    def merge(have: DataFrame, new: DataFrame) -> DataFrame:
        first = [F.lit(None).cast(new.schema[c].dataType).alias(c) for c in order]  # nulls come first
        before = have.select(key, *first, F.lit("incident").alias("kind"), F.col("severity_last").alias("severity"), F.col("severity_rank_peak").alias("severity_rank"), "status", "chain", "protocol")
        return tables.upsert_by_policy(before.unionByName(new.select(before.columns)), key, order)

    return merge
