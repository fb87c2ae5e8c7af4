"""A table of named partitions with versions: staged writes, a manifest as the commit, pinned readers.

Below the table's folder, ``data/attempt=<id>/<by>=<name>`` holds what one write staged, and
``versions/<n>.json`` says which folders make up version n. A write becomes visible when its
manifest gets its name; until then, and for ever if it dies, nothing refers to its files.
Partitions that a write does not name keep the files they have.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from benthos.session import materialize

#: Bytes of rows that a file is sized for.
FILE_BYTES = 128 << 20
#: Ranges of hashes in which files are numbered.
RANGES = 1024


def spread_by_bytes(df: DataFrame, by: list[str], file_bytes: int | None = None) -> DataFrame:
    """The rows dealt so that each combination of ``by`` gets as many files as its bytes ask for.

    Bytes are those of the rows as JSON, counted per combination; rows are dealt by a number of
    their own, so equal rows spread as well. Files are numbered over all combinations and a
    task gets one of them, so no task holds more than a file's rows. The table of sizes, a
    row per combination, is written before it is joined, so a short one moves no rows.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    keyed = df.withColumn("__by", F.to_json(F.struct(*by)))
    sizes = materialize(keyed.groupBy("__by").agg(F.sum(size).alias("bytes")).withColumn("files", F.ceil(F.col("bytes") / (file_bytes or FILE_BYTES))), "file-sizes")
    # files before each combination: numbers run within ranges of hashes, whose sums run over a row each
    ranged = sizes.withColumn("__range", F.pmod(F.xxhash64("__by"), F.lit(RANGES)))
    upto = F.sum("files").over(Window.partitionBy("__range").orderBy("__by").rowsBetween(Window.unboundedPreceding, -1))
    per = ranged.groupBy("__range").agg(F.sum("files").alias("n"))
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.withColumn("__in", F.coalesce(upto, F.lit(0))).join(per.select("__range", F.coalesce(before, F.lit(0)).alias("__before")), "__range")
    starts = materialize(starts.select("__by", "files", (F.col("__in") + F.col("__before")).alias("first")), "file-starts")
    total = max(1, int(sizes.agg(F.sum("files")).first()[0] or 1))
    seat = F.col("first") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("files"))
    return keyed.join(starts, "__by").withColumn("__seat", seat.cast("int")).repartitionById(total, "__seat").select(*df.columns)


class VersionedTable:
    """Partitions by one column, replaced as a whole; versions count from 1."""

    def __init__(self, spark: SparkSession, folder: str, by: str):
        self.spark, self.folder, self.by = spark, folder.rstrip("/"), by
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.folder}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, parts: {name: folder below data}}; without a version the latest, or an empty one."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "schema": None, "parts": {}}
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"{self.folder} has no version {version}")
        lines = self.spark.read.text(f"{self.folder}/versions/{version}.json", wholetext=True).first()[0]
        return json.loads(lines)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; later writes and clean-ups that keep it do not change it."""
        now = self.manifest(version)
        if not now["version"]:
            raise ValueError(f"{self.folder} has no version yet")
        schema = StructType.fromJson(json.loads(now["schema"]))
        paths = [f"{self.folder}/data/{p}" for p in now["parts"].values()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        got = self.spark.read.option("basePath", f"{self.folder}/data").schema(schema.add("attempt", "string")).parquet(*paths)
        return got.drop("attempt").select(*[f.name for f in schema if f.name != "attempt"])

    def replace(self, rows: DataFrame, file_bytes: int | None = None) -> int:
        """All partitions that ``rows`` have take the place of those of the same names; the new version.

        The files are staged first; if that fails, no version has them. Two writers at once: the
        one that claims the number second gets an error, and its files belong to no version.
        Names must be neither null nor empty.
        """
        before = self.manifest()
        if before["schema"] and json.loads(before["schema"])["fields"] != json.loads(rows.schema.json())["fields"]:
            raise ValueError("rows have another schema than the table")
        name = F.col(self.by).cast("string")
        safe = F.when(name.isNull() | (name == ""), F.raise_error(F.lit(f"a partition without a name in {self.by}"))).otherwise(F.col(self.by))
        attempt = f"attempt={uuid.uuid4().hex}"
        spread_by_bytes(rows.withColumn(self.by, safe), [self.by], file_bytes).write.partitionBy(self.by).parquet(f"{self.folder}/data/{attempt}")
        return self._commit(before, rows, attempt)

    def _commit(self, before: dict, rows: DataFrame, attempt: str) -> int:
        from urllib.parse import unquote

        staged = [n for n in self._names(f"data/{attempt}") if n.startswith(f"{self.by}=")]
        parts = before["parts"] | {unquote(n[len(self.by) + 1 :]): f"{attempt}/{n}" for n in staged}
        version = before["version"] + 1
        made = json.dumps({"version": version, "schema": rows.schema.json(), "parts": parts})
        if not self._fs.createNewFile(self._path(f"{self.folder}/versions/{version}.claim")):
            raise ValueError(f"version {version} of {self.folder} was written meanwhile")
        out = self._fs.create(self._path(f"{self.folder}/versions/{version}.tmp"), True)
        out.write(bytearray(made.encode()))
        out.close()
        if not self._fs.rename(self._path(f"{self.folder}/versions/{version}.tmp"), self._path(f"{self.folder}/versions/{version}.json")):
            raise ValueError(f"version {version} of {self.folder} could not be named")
        return version

    def clean(self, keep: int = 1) -> list[str]:
        """Drop all but the last ``keep`` versions, and staged folders of no kept version; what was dropped.

        To be called while nobody writes: a write that is still staging looks like one that died.
        """
        known = self.versions()
        kept = known[-keep:] if keep else []
        used = {p.split("/")[0] for v in kept for p in self.manifest(v)["parts"].values()}
        gone = []
        for v in known[: len(known) - len(kept)]:
            self._fs.delete(self._path(f"{self.folder}/versions/{v}.json"), False)
            gone.append(f"versions/{v}.json")
        latest = max(known, default=0)
        for n in self._names("versions"):  # claims of writers that died before they named their version
            if n.endswith((".claim", ".tmp")) and int(n.split(".")[0]) > latest:
                self._fs.delete(self._path(f"{self.folder}/versions/{n}"), False)
                gone.append(f"versions/{n}")
        for n in self._names("data"):
            if n not in used:
                self._fs.delete(self._path(f"{self.folder}/data/{n}"), True)
                gone.append(f"data/{n}")
        return gone
