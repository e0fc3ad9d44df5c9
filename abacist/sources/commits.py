"""Tables whose content is what the latest manifest names.

A table is a folder with data folders that are written once and a log of numbered manifests. Each manifest names the data folders
of its version by part (a batch, or a bucket of keys); it is written beside the log and moved there under the next number, which fails
if another writer was first. So a batch or an update becomes visible as a whole or not at all, a job that failed half-way
leaves only folders that nobody reads, and readers of an older version are not disturbed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.sources.sinks import upsert
from abacist.sources.tables import conform

#: Buckets of keys of a table that is updated. A change rewrites only the buckets that its keys are in.
BUCKETS = 64
#: A writer that finds its version taken tries again on the new one, so many times.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer changed the same part."""


class Log:
    """The manifests of one table: version -> {part: data folder}."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.jvm = spark, path, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self._path("_log").getFileSystem(self.conf)

    def _path(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def version(self) -> int:
        """The latest version; 0 for a table that has none."""
        if not self.files.exists(self._path("_log")):
            return 0
        names = [s.getPath().getName() for s in self.files.listStatus(self._path("_log"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def parts(self, version: int) -> dict[str, str]:
        if version == 0:
            return {}
        stream = self.files.open(self._path("_log", f"{version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, version: int, parts: dict[str, str]) -> bool:
        """Make ``parts`` the content of ``version``; False if there is such a version already."""
        draft, final = self._path("_log", f"_draft-{uuid.uuid4().hex}"), self._path("_log", f"{version:012d}.json")
        self.files.mkdirs(self._path("_log"))
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        out.close()
        never_replace = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.conf)
        try:
            context.rename(draft, final, never_replace)
        except Exception as taken:
            self.files.delete(draft, False)
            if "FileAlreadyExists" in str(taken):
                return False
            raise
        return True

    def commit(self, change: dict[str, str], based_on: dict[str, str] | None = None) -> int:
        """Replace the parts in ``change``; they must still be those of ``based_on``, if given. The new version."""
        for _ in range(TRIES):
            version = self.version()
            now = self.parts(version)
            if based_on is not None and any(now.get(part) != based_on.get(part) for part in change):
                raise Conflict(f"changed meanwhile: {self.path}")
            if self.publish(version + 1, {**now, **change}):
                return version + 1
        raise Conflict(f"too many writers: {self.path}")


def _folder(path: str, part: str) -> str:
    return f"{path}/data/{part}-{uuid.uuid4().hex}"


def append(rows: DataFrame, path: str, batch: str, table: str | None = None) -> int:
    """Add a batch of rows, with the declared columns and defaults of ``table`` if given. The version it is in.

    A batch that is written again, as by a job that failed or ran twice, takes the place of what it wrote before.
    """
    folder = _folder(path, "batch")
    (rows if table is None else conform(rows, table)).write.parquet(folder)
    return Log(rows.sparkSession, path).commit({f"batch={batch}": folder})


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest if none is given."""
    log = Log(spark, path)
    parts = log.parts(log.version() if version is None else version)
    if not parts:
        raise FileNotFoundError(f"no committed version: {path}")
    return spark.read.parquet(*sorted(set(parts.values())))


def _buckets(keys: Sequence[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _write_buckets(rows: DataFrame, keys: Sequence[str], path: str, numbers: list[int]) -> dict[str, str]:
    """Rows of some buckets in a new folder for each; buckets without rows have a folder too, so that readers know the columns."""
    folder = _folder(path, "buckets")
    bucketed = rows.withColumn("_bucket", _buckets(keys))
    bucketed.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    spark = rows.sparkSession
    log = Log(spark, path)
    out = {}
    for number in numbers:
        part = f"{folder}/_bucket={number}"
        if not log.files.exists(spark._jvm.org.apache.hadoop.fs.Path(part)):
            spark.createDataFrame([], rows.schema).write.parquet(part)
        out[f"bucket={number:05d}"] = part
    return out


def create(rows: DataFrame, keys: Sequence[str], path: str) -> int:
    """A table that is updated by ``keys``, from its first rows."""
    return Log(rows.sparkSession, path).commit(_write_buckets(rows, keys, path, list(range(BUCKETS))), based_on={})


def merge(changes: DataFrame, keys: Sequence[str], newest: str, path: str, table: str | None = None) -> int:
    """Per key the change with the latest ``newest``, else the old row (see ``sinks.upsert``). The new version.

    The changes' keys name the buckets; only these are read, joined and written anew, the others keep their files.
    """
    spark = changes.sparkSession
    log = Log(spark, path)
    before = log.parts(log.version())
    touched = sorted(r[0] for r in changes.select(_buckets(keys)).distinct().collect())  # BUCKETS numbers at most
    if not touched:
        return log.version()
    old = spark.read.parquet(*[before[f"bucket={number:05d}"] for number in touched])
    return log.commit(_write_buckets(upsert(old, changes, keys, newest, table), keys, path, touched), based_on=before)
