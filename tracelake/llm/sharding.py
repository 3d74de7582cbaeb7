"""Sharding: a table of immutable Parquet shards, compacted by size tiers behind a manifest.

Method (size-tiered compaction).  An append writes its rows as small shards, a file a task,
and never touches what is there.  Shards of similar size form a tier (powers of ``fanout``);
when a tier holds ``fanout`` shards, runs of them are merged into one file each, of at most
``target_bytes``; merged files enter a higher tier, so a byte is rewritten once a tier.
Arrivals above the target (an append's file is a whole split of its input), and shards too
large for two to fit one file, are dealt row by row over files near the target.  A state of the table is a numbered manifest, the list of its files.  It is written aside and
renamed to its number without overwriting, which HDFS and local file systems do as a whole or refuse
(object stores without an atomic rename need a committer of their own):
readers see the state before or after, and of two writers with the same number one must try
again.  A manifest has the table's schema, so a shard without a column, or with more than
another, reads alike in any order of arrival.  Files that neither of the last two manifests lists are removed after a commit, so readers of the
version before are not cut off; files of a refused commit go at once, those of a commit whose
outcome can't be seen stay.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

RUNS_A_JOB = 100


class Refused(Exception):
    """Another writer committed the version first."""


def shard_of_row() -> Column:
    """The file a row was read from; a function, so that no column's name can hide it."""
    return F.substring_index(F.input_file_name(), "/data/", -1)


class ShardedTable:
    """A versioned table of shards below ``path``, in any store that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, target_bytes: int = 128 << 20, small_bytes: int = 1 << 20):
        self.spark, self.path, self.fanout, self.target, self.small = spark, path.rstrip("/"), fanout, target_bytes, small_bytes
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # --- manifests ---

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        where = self._path("manifests")
        if not self.fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(where)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the last by default; version 0 is the empty table."""
        version = version if version is not None else (self.versions() or [0])[-1]
        if version == 0:
            return {"version": 0, "shards": [], "schema": None}
        stream = self.fs.open(self._path(f"manifests/v{version:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], schema: str | None = None) -> dict:
        """Make ``shards`` the version after ``base``; ``Refused`` if another writer made that version."""
        new = {"version": base["version"] + 1, "shards": shards, "schema": schema or base.get("schema"), "writer": uuid.uuid4().hex}
        aside = self._path(f"manifests/_{new['writer']}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        try:
            self._rename(aside, self._path(f"manifests/v{new['version']:08d}.json"))
        except Exception as e:
            # the rename may have succeeded with its answer lost: what the version holds decides
            if new["version"] in self.versions():
                if self.manifest(new["version"]).get("writer") == new["writer"]:
                    return new
                self.fs.delete(aside, False)
                raise Refused(f"version {new['version']} exists") from e
            raise
        return new

    def _rename(self, source, target) -> None:
        """Rename without overwriting."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else self.fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context.rename(source, target, options)

    # --- writing ---

    def _written(self, df: DataFrame, tier: int) -> list[dict]:
        """Shards of the rows, those that have any; counted from the files' footers."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")
        rows = {r.f: r.n for r in written.groupBy(shard_of_row().alias("f")).agg(F.count("*").alias("n")).collect()}  # a row a file
        out = []
        for s in sorted(self.fs.listStatus(self._path(folder)), key=lambda s: s.getPath().getName()):
            name = f"{folder}/{s.getPath().getName()}"
            if name.removeprefix("data/") in rows:
                out.append({"file": name, "bytes": s.getLen(), "level": tier, "rows": rows[name.removeprefix("data/")]})
            elif name.endswith(".parquet"):
                self.fs.delete(s.getPath(), False)
        return out

    def append(self, df: DataFrame, arrivals: int | None = None) -> dict:
        """Add the rows of ``df`` as small shards, a file a partition of ``df`` (``arrivals`` of them on request, by round robin).

        All columns are stored as they are, nulls and repeated rows included.  Columns that
        the table hasn't yet are added to its schema, and rows before them read as null; columns
        that ``df`` lacks are null in its rows.  A column of another type than the table's, or
        names that differ in case only, are refused before anything is written.  An empty
        ``df`` commits a version without new shards.  If another writer commits first, the
        append is undone and raises ``Refused``.
        """
        base = self.manifest()
        schema = self._widened(base, df.schema)
        new = self._written(df if arrivals is None else df.repartition(arrivals), 0)
        return self._commit_new(base, base["shards"], new, schema)

    def _widened(self, base: dict, more: StructType) -> str:
        own = StructType.fromJson(json.loads(base["schema"])) if base.get("schema") else StructType([])
        fields = {f.name: f for f in own.fields}
        for f in more.fields:
            if f.name not in fields:
                fields[f.name] = StructField(f.name, f.dataType, True)
            elif fields[f.name].dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        if len({n.lower() for n in fields}) < len(fields):
            raise ValueError("columns whose names differ in case only")
        return StructType([*fields.values()]).json()

    def _apart(self) -> SparkSession:
        """A copy of the session in which a union of single partitions keeps them apart, a file each."""
        copy = SparkSession(self.spark.sparkContext, jsparkSession=self.spark._jsparkSession.cloneSession())
        copy.conf.set("spark.sql.unionOutputPartitioning", "false")
        return copy

    def _shards(self, m: dict, shards: list[dict], spark: SparkSession | None = None) -> DataFrame:
        """The rows of some shards, with the manifest's columns."""
        return (spark or self.spark).read.schema(StructType.fromJson(json.loads(m["schema"]))).parquet(*(f"{self.path}/{s['file']}" for s in shards))

    def tier(self, size: int) -> int:
        n, limit = 0, self.small
        while size > limit:
            n, limit = n + 1, limit * self.fanout
        return n

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge: at least ``fanout`` shards of a tier, together no larger than the target."""
        out, tiers = [], {}
        for s in shards:
            if s["bytes"] < self.target * 3 // 4:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        for _, own in sorted(tiers.items()):
            if len(own) < self.fanout:
                continue
            run, size = [], 0
            for s in sorted(own, key=lambda s: (s["bytes"], s["file"])):
                if run and size + s["bytes"] > self.target:
                    out.append(run)
                    run, size = [], 0
                run, size = [*run, s], size + s["bytes"]
            out.append(run)
        return [r for r in out if len(r) > 1]

    def deals(self, shards: list[dict]) -> list[list[dict]]:
        """Groups to deal anew over files near the target: arrivals above it, and ``fanout`` or more shards of which no two fit one file.

        The latter lose at least one file a round.  What was merged or dealt is not cut
        again: only a row larger than the target makes such a file.
        """
        over = [s for s in shards if s["level"] == 0 and s["bytes"] > self.target * 5 // 4]
        single = [s for s in shards if self.target // 2 < s["bytes"] < self.target * 3 // 4]
        out, size = [], 0
        for s in over + (single if over or len(single) >= self.fanout else []):
            if not out or size + s["bytes"] > RUNS_A_JOB * self.target:  # bounds what a job shuffles
                out.append([])
                size = 0
            out[-1].append(s)
            size += s["bytes"]
        return [g for g in out if len(g) >= self.fanout or any(s["bytes"] > self.target for s in g)]

    def compact(self) -> dict:
        """One round: merge the planned runs, a task a run, deal what can't be merged, and commit.

        Rows, nulls, repeated ones and all columns stay as they are.  Without a full tier
        nothing is written.  If another writer commits first, the round is undone and raises
        ``Refused``; the shards that it read stay, whatever happens.
        """
        base = self.manifest()
        runs = self.plan(base["shards"])
        gone = {s["file"] for r in runs for s in r}
        deals = self.deals([s for s in base["shards"] if s["file"] not in gone])
        if not runs and not deals:
            return base
        gone |= {s["file"] for g in deals for s in g}
        level = 1 + max(s["level"] for r in runs + deals for s in r)
        new, apart = [], self._apart()
        for g in deals:
            files = -(-sum(s["bytes"] for s in g) // self.target)
            new += self._written(self._shards(base, g).repartition(files), level)
        for at in range(0, len(runs), RUNS_A_JOB):  # a job writes many runs, a task each; plans stay small
            parts = [self._shards(base, r, apart).coalesce(1) for r in runs[at : at + RUNS_A_JOB]]
            new += self._written(reduce(DataFrame.unionByName, parts), level)
        done = self._commit_new(base, [s for s in base["shards"] if s["file"] not in gone], new)
        self.clean()
        return done

    def _commit_new(self, base: dict, kept: list[dict], new: list[dict], schema: str | None = None) -> dict:
        """Commit; the new files go if another writer was first, and only then."""
        try:
            return self.commit(base, kept + new, schema)
        except Refused:
            for s in new:
                self.fs.delete(self._path(s["file"]), False)
            raise

    def settle(self) -> dict:
        """Compact until no tier is full; each round leaves fewer shards below the target or above it, so this ends.

        A table that is empty, or settled, stays at its version.
        """
        while True:
            before = self.manifest()["version"]
            if self.compact()["version"] == before:
                return self.manifest()

    def clean(self, keep_versions: int = 2) -> None:
        """Remove files that the last ``keep_versions`` manifests don't list, and older manifests."""
        versions = self.versions()
        kept = {s["file"] for v in versions[-keep_versions:] for s in self.manifest(v)["shards"]}
        old = {s["file"] for v in versions[:-keep_versions] for s in self.manifest(v)["shards"]} - kept
        for v in versions[:-keep_versions]:
            self.fs.delete(self._path(f"manifests/v{v:08d}.json"), False)
        for f in old:
            self.fs.delete(self._path(f), False)

    # --- reading ---

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, with the ``shard`` each is in (``_shard`` where the table has such a column, and so on); None for an empty table."""
        df = self.rows(version)
        if df is None:
            return None
        name = "shard"
        while name in df.columns:
            name = f"_{name}"
        return df.select("*", shard_of_row().alias(name))

    def rows(self, version: int | None = None) -> DataFrame | None:
        m = self.manifest(version)
        return self._shards(m, m["shards"]) if m["shards"] else None


def shard_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", fanout: int = 4, target_bytes: int = 32 << 20, arrivals: int = 4) -> DataFrame:
    """Append ``docs`` in ``arrivals`` parts, compact, and return where each row is: ``doc_id, shard_no, shard_rows, text_bytes, version``.

    Each arrival is an append of its own, of the rows whose hash falls to it, so that a table
    of any size has several versions and goes through the tiers; together they are all rows.
    ``shard_no`` numbers the last manifest's shards by file, from 0.  A row for each row of
    ``docs``, nulls, repeats and empty or very long texts included; all columns are stored.
    Columns named as the index's own don't clash: the index reads id and text only.  An
    empty table commits versions without shards and gives no rows.
    """
    spark = docs.sparkSession
    table = ShardedTable(spark, path, fanout, target_bytes)
    arrival = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(arrivals))
    for k in range(arrivals):
        table.append(docs.where(arrival == k))
    m = table.settle()
    rows = table.rows()
    if rows is None:
        return spark.createDataFrame([], "doc_id long, shard_no int, shard_rows long, text_bytes long, version long")
    where = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("text_bytes"), shard_of_row().alias("shard"))
    files = sorted(s["file"].removeprefix("data/") for s in m["shards"])
    number = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "shard string, shard_no int")
    counts = where.groupBy("shard").agg(F.count("*").alias("shard_rows"))
    return where.join(number.join(counts, "shard"), "shard").select("doc_id", "shard_no", "shard_rows", "text_bytes", F.lit(m["version"]).cast("long").alias("version"))
