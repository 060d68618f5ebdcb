"""Tables that change together: parts of rows and of deletions, and a manifest that says which parts are in effect.

A commit writes all its parts first and one manifest last; readers resolve the newest manifest first. A write that fails
leaves parts that no manifest names, and the version before it stays what readers see. Manifests are numbered and
made by a rename that fails where one of that number exists, so that of two writers one commits and the other
is told.

A row part holds newer versions of rows by the table's key, a deletion part values of some columns (a run, say)
whose rows are gone. Reading takes each key's newest row and leaves out what was deleted after it. `compact` writes what
a table holds as one part; only then do deleted rows leave the disk.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import RUN_ID_RE


class CommitConflict(Exception):
    """Another commit came first."""


def workspace(spark: SparkSession) -> str:
    """A folder of its own in the shared folder, spark.checkpoint.dir; in local mode one is made if it isn't set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


class Library:
    """The tables under a folder. keys: the key columns of each table."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys

    # ---- manifests

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return jvm, path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest manifest; 0 if there is none."""
        _, path, fs = self._fs()
        folder = path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def _manifest(self, version: int) -> dict[str, list[dict]]:
        if not version:
            return {}
        jvm, path, fs = self._fs()
        stream = fs.open(path(f"{self.root}/manifests/{version:012d}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict[str, list[dict]], version: int) -> None:
        jvm, path, fs = self._fs()
        draft = path(f"{self.root}/manifests/{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, path(f"{self.root}/manifests/{version:012d}.json"), none)
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error) or "already exists" in str(error):
                raise CommitConflict(f"version {version} was committed by another writer") from error
            raise

    # ---- reading

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The table at a version (the newest); null if it has no rows part."""
        parts = self._manifest(self.version() if version is None else version).get(table, [])
        rows = [p for p in parts if p["kind"] == "rows"]
        if not rows:
            return None
        whole = self._union(rows)
        columns = [c for c in whole.columns if c != "_commit"]
        if len(rows) > 1:
            newest = F.max_by(F.struct("_commit", *columns), "_commit").alias("_row")
            whole = whole.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(self.keys[table]))).agg(newest).select("_row.*")
        gone: dict[tuple[str, ...], list[dict]] = {}
        for p in parts:
            if p["kind"] == "gone":
                gone.setdefault(tuple(p["by"]), []).append(p)
        for by, deletions in gone.items():
            dead = self._union(deletions).groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.max("_commit").alias("_until"))
            same = [F.col(c) == F.col(f"_{c}") for c in by]
            whole = whole.join(dead, [*same, F.col("_commit") < F.col("_until")], "left_anti")
        return whole.select(columns)

    def _union(self, parts: list[dict]) -> DataFrame:
        out = None
        for p in parts:
            one = self.spark.read.schema(p["schema"]).parquet(f"{self.root}/{p['path']}").withColumn("_commit", F.lit(p["commit"]))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    # ---- writing

    def commit(self, rows: dict[str, DataFrame] | None = None, gone: dict[str, tuple[DataFrame, list[str]]] | None = None, expected: int | None = None) -> int:
        """Put rows (by table, keys distinct within a commit) and deletions (by table: values, their columns) into effect together.

        expected: the version that the changes were made from; CommitConflict if it isn't the newest any more. Without it
        the changes must hold on whatever version is the newest. Returns the new version.
        """
        written = [(t, self._write(t, df, "rows")) for t, df in (rows or {}).items()]
        written += [(t, self._write(t, df.select(by).distinct(), "gone") | {"by": list(by)}) for t, (df, by) in (gone or {}).items()]
        return self._effect(lambda manifest, number: {**manifest, **{t: manifest.get(t, []) + [p | {"commit": number} for own, p in written if own == t] for t in {t for t, _ in written}}}, expected)

    def replace_runs(self, tables: dict[str, DataFrame], runs: DataFrame | None = None, run: str = "run_id", expected: int | None = None) -> int:
        """Put the runs in tables in place of what the library has of them, in all the tables at once.

        runs: the runs to replace (run), where some have no rows any more; those of any of the tables else. Readers see all of
        a run's rows in all tables as they were, or as they are. Run ids must be safe as names.
        """
        if runs is None:
            for df in tables.values():
                runs = df.select(run) if runs is None else runs.union(df.select(run))
        runs = keep(runs.distinct())
        bad = runs.filter(~F.coalesce(F.col(run).cast("string").rlike(RUN_ID_RE), F.lit(False))).limit(1).collect()
        if bad:
            raise ValueError(f"unsafe run id: {bad[0][0]!r}")
        held = self._manifest(self.version())
        return self.commit(tables, {t: (runs, [run]) for t in tables if t in held}, expected)

    def compact(self, table: str) -> int:
        """Write what the table holds now as one part. A commit meanwhile is a CommitConflict."""
        version = self.version()
        part = self._write(table, self.read(table, version), "rows")
        return self._effect(lambda manifest, number: {**manifest, table: [part | {"commit": number}]}, version)

    def _write(self, table: str, df: DataFrame, kind: str) -> dict:
        path = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        return {"kind": kind, "path": path, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}

    def _effect(self, change, expected: int | None) -> int:
        while True:
            version = self.version()
            if expected is not None and version != expected:
                raise CommitConflict(f"made from version {expected}, but {version} is the newest")
            try:
                self._publish(change(self._manifest(version), version + 1), version + 1)
                return version + 1
            except CommitConflict:
                if expected is not None:
                    raise


def keep(df: DataFrame, *done: DataFrame) -> DataFrame:
    """df written to the workspace and read back, so that what it took isn't done again, and a lost executor costs no recomputation.

    done: tables kept earlier that nothing needs any more once df is written; their files go.
    """
    spark = df.sparkSession
    path = workspace(spark)
    df.write.parquet(path)
    for old in done:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old._kept)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out
