"""Tables by key that are changed bucket by bucket and published whole.

Rows are dealt to buckets by a hash of their keys. A change rewrites the
buckets that it touches and no others; the new files stand beside the old
ones until a manifest that names them appears under the next version's
name, which one rename does. Readers take the highest version there is:
they see the table before a change or after it. Of two writers that began
from one version the second fails to publish and may try again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Lost(RuntimeError):
    """Another writer has published first."""


class Files:
    """The few file system calls that manifests need, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(folder))) if self.fs.exists(self.at(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file that is there whole or not at all, and fail if there is one."""
        staged = self.at(f"_staged-{uuid.uuid4().hex}")
        stream = self.fs.create(staged, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(staged, self.at(name)):
            self.fs.delete(staged, False)
            raise Lost(name)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _name(version: int) -> str:
    return f"manifests/{version:012d}.json"


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The latest manifest, or that of a version; None where there is no table."""
    files = Files(spark, path)
    there = [int(n.split(".")[0]) for n in files.names("manifests") if n.endswith(".json")]
    if not there:
        return None
    return json.loads(files.read(_name(version if version is not None else max(there))))


def bucket(keys: list[str], n: int):
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def read_table(spark: SparkSession, path: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a table, or of some of its buckets."""
    m = manifest(spark, path, version)
    if m is None:
        raise FileNotFoundError(path)
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(m["schema"])
    folders = sorted(f"{path}/{f}" for b, f in m["buckets"].items() if only is None or int(b) in only)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], buckets: int = 64) -> int:
    """Put the rows of ``new`` in the place of those that have their keys, or beside them; returns the version that shows it.

    The number of buckets is the first version's. Keys that repeat in
    ``new`` stay repeated; null keys equal nothing, so that such rows are
    added.
    """
    from .sinks import merge_rows

    files, m = Files(spark, path), manifest(spark, path)
    if m is None:
        files.fs.mkdirs(files.at("manifests"))
        m = {"version": -1, "of": buckets, "keys": keys, "buckets": {}}
    n, version = m["of"], m["version"] + 1
    known = {f["name"]: f["type"] for f in m.get("schema", {}).get("fields", ())}
    if any(known.get(f["name"], f["type"]) != f["type"] for f in new.schema.jsonValue()["fields"] if f["name"] in keys):
        raise ValueError("keys of another type would be dealt to other buckets")
    own = f"data/{version:012d}-{uuid.uuid4().hex}"
    touched = sorted(r["bucket"] for r in new.select(bucket(keys, n).alias("bucket")).distinct().collect())  # one row a bucket at most
    old = [b for b in touched if str(b) in m["buckets"]]
    merged = merge_rows(read_table(spark, path, only=old), new, keys) if old else new
    dealt = merged.withColumn("_bucket", bucket(keys, n))
    dealt.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(files.root + "/" + own)
    told = {name.split("=")[1] for name in files.names(own) if name.startswith("_bucket=")}
    m["buckets"] |= {b: f"{own}/_bucket={b}" for b in told}
    files.publish(_name(version), json.dumps(m | {"version": version, "schema": new.schema.jsonValue()}))
    return version


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete versions but the last ``keep``, and the files that only they name; returns how many folders went."""
    files = Files(spark, path)
    versions = [int(n.split(".")[0]) for n in files.names("manifests") if n.endswith(".json")]
    for v in versions[:-keep]:
        files.delete(_name(v))
    used = {f for v in versions[-keep:] for f in manifest(spark, path, v)["buckets"].values()}
    gone = [f"data/{d}/{b}" for d in files.names("data") for b in files.names(f"data/{d}") if b.startswith("_bucket=") and f"data/{d}/{b}" not in used]
    for f in gone:
        files.delete(f)
    return len(gone)
