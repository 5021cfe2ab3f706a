"""Tables in versions: folders written once, and a manifest that says which of them count.

A commit writes new folders only and then puts its manifest in place by one
rename. Who reads meanwhile has the version before or the one after, never parts of both;
a writer that fails leaves folders that no manifest names. The manifest also keeps the
last batch number of each query, in the same rename as the rows.

    <path>/_manifests/<version>.json
    <path>/<table>/v=<token>/<partition folders>
"""

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType


class VersionConflict(RuntimeError):
    """Another writer has committed since this one read the manifest."""


@dataclass
class Manifest:
    """``parts``: table, partition, and what is known of it: its ``tokens`` and statistics.

    As long as the table has partitions, whatever the number of its rows.
    """

    version: int = 0
    settings: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    parts: dict[str, dict[str, dict]] = field(default_factory=dict)

    def has_batch(self, query: str | None, batch_id: int | None) -> bool:
        """Whether a batch of a query, or a later one, is in this version."""
        return query is not None and batch_id is not None and self.batches.get(query, -1) >= batch_id

    def after(self, query: str | None = None, batch_id: int | None = None) -> "Manifest":
        """The next version, alike but for the number of the batch."""
        parts = {table: dict(own) for table, own in self.parts.items()}
        batches = self.batches | ({query: batch_id} if query is not None and batch_id is not None else {})
        return Manifest(self.version + 1, dict(self.settings), batches, parts)


def new_token() -> str:
    return f"t{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, whichever store that is."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def _names(spark: SparkSession, path: str) -> list[str]:
    files, name = _files(spark, path)
    return [status.getPath().getName() for status in files.listStatus(name)] if files.exists(name) else []


def _manifest_path(path: str, version: int) -> str:
    return f"{path}/_manifests/{version:019}.json"


def load(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest manifest, or that of a version; an empty one where there is no table."""
    if version is None:
        known = [int(n.removesuffix(".json")) for n in _names(spark, f"{path}/_manifests") if n.endswith(".json")]
        if not known:
            return Manifest()
        version = max(known)
    files, name = _files(spark, _manifest_path(path, version))
    stream = files.open(name)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(**json.loads(text))


def commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Makes a version the newest, unless its number is taken."""
    files, final = _files(spark, _manifest_path(path, manifest.version))
    if files.exists(final):
        raise VersionConflict(f"{path} has a version {manifest.version} already")
    files, hidden = _files(spark, f"{path}/_manifests/.{new_token()}")
    stream = files.create(hidden)
    try:
        stream.write(bytearray(json.dumps(manifest.__dict__).encode()))
    finally:
        stream.close()
    if not files.rename(hidden, final):
        raise VersionConflict(f"{path} has a version {manifest.version} already")


def folders(path: str, manifest: Manifest, table: str, partitions: Iterable[str]) -> list[str]:
    own = manifest.parts.get(table, {})
    return [f"{path}/{table}/v={token}/{part}" for part in partitions for token in own[part]["tokens"]]


def read_parts(
    spark: SparkSession, path: str, manifest: Manifest, table: str, schema: StructType, partitions: Iterable[str]
) -> DataFrame:
    """Some partitions of a version: no other folder is listed or opened."""
    chosen = folders(path, manifest, table, partitions)
    if not chosen:
        return spark.createDataFrame([], schema)
    named = StructType([*schema.fields, StructField("v", StringType())])
    return spark.read.schema(named).option("basePath", f"{path}/{table}").parquet(*chosen).select(*schema.names)


def partitions_written(spark: SparkSession, path: str, table: str, token: str) -> list[str]:
    """Partition folders that a commit in progress has written, from their names."""

    def below(folder: str) -> list[str]:
        out = []
        for name in _names(spark, f"{path}/{table}/v={token}{folder}"):
            if "=" in name:
                deeper = below(f"{folder}/{name}")
                out += deeper or [f"{folder}/{name}"]
        return out

    return [part.removeprefix("/") for part in below("")]


def vacuum(spark: SparkSession, path: str, tables: Iterable[str], keep: int = 2) -> int:
    """Deletes folders that none of the last ``keep`` versions names; how many went.

    Not while a writer is at work: its folders are not named yet. Readers of older versions lose them.
    """
    known = sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{path}/_manifests") if n.endswith(".json"))
    named = {
        (table, token)
        for version in known[-keep:]
        for table, own in load(spark, path, version).parts.items()
        for part in own.values()
        for token in part["tokens"]
    }
    gone = 0
    for table in tables:
        for name in _names(spark, f"{path}/{table}"):
            if name.startswith("v=") and (table, name[2:]) not in named:
                files, folder = _files(spark, f"{path}/{table}/{name}")
                gone += bool(files.delete(folder, True))
    for version in known[:-keep]:
        files, name = _files(spark, _manifest_path(path, version))
        files.delete(name, False)
    return gone
