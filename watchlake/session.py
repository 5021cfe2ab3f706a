"""Session settings and the shared working folder."""

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from itertools import count

from pyspark.sql import DataFrame, SparkSession

# What a task takes in at most, of files or of shuffled rows. Event rows grow some twenty times when
# they are unpacked to be sorted, so a task's memory is bounded by this and not by the size of the table.
TASK_BYTES = 16 << 20
TASK_SETTINGS = {
    "spark.sql.files.maxPartitionBytes": f"{TASK_BYTES}b",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{TASK_BYTES}b",
}

# What a job leaves on disk. Shuffle files go when the job that wrote them ends: else they lie there until the
# driver happens to collect its garbage. Tables are written densely, since event rows carry their payload as text.
DISK_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}

# How many parts a shuffle starts with: a part is a task's share at most, whatever its bytes.
_SHUFFLE_PARTS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")

# Everything here has a reason at scale; sizes are left to the cluster.
SETTINGS = {
    # Runtime re-planning: coalesces small shuffle partitions, splits skewed
    # joins, and broadcasts a side only once its real size is known.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Event times are text without an offset; pin the zone that dates derive from.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object that repeats a key keeps the last value instead of failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Checkpointed rows go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
} | TASK_SETTINGS


def build_session(name: str = "watchlake", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _size(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def little_on_disk(spark: SparkSession) -> Iterator[None]:
    """What runs within goes by ``DISK_SETTINGS``; all are as before at the end."""
    before = {key: spark.conf.get(key, None) for key in DISK_SETTINGS}
    try:
        for key, value in DISK_SETTINGS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, own in before.items():
            spark.conf.unset(key) if own is None else spark.conf.set(key, own)


@contextmanager
def bounded_tasks(spark: SparkSession, parts: int = 0) -> Iterator[None]:
    """What runs within takes at most ``TASK_BYTES`` a task, in a session that sets other sizes, too.

    A shuffle starts with ``parts`` parts at least: sizes only merge parts, so a fixed number
    of them would let a task's share grow with the table. Smaller sizes and larger
    numbers of the session stay; all are as before at the end.
    """
    before = {key: spark.conf.get(key) for key in TASK_SETTINGS}
    numbers = {key: own for key in _SHUFFLE_PARTS if (own := spark.conf.get(key, None)) is not None}
    try:
        for key, own in before.items():
            if _size(own) > TASK_BYTES:
                spark.conf.set(key, TASK_SETTINGS[key])
        for key, own in numbers.items():
            spark.conf.set(key, str(max(int(own), parts)))
        yield
    finally:
        for key, own in (before | numbers).items():
            spark.conf.set(key, own)


def in_bounded_tasks(query: Callable, parts: Callable[..., int] | None = None) -> Callable:
    """``query`` with the jobs that it runs itself in ``bounded_tasks`` and with ``little_on_disk``.

    ``parts`` takes what the query takes.
    """

    @wraps(query)
    def run(spark: SparkSession, *given, **named):
        with little_on_disk(spark), bounded_tasks(spark, parts(spark, *given, **named) if parts else 0):
            return query(spark, *given, **named)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only a local master, where the driver and the executors are one process, may
    fall back to a temporary folder; anything else must name shared storage.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="watchlake-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_work_folder(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path``, of whichever store, was there to be deleted."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True))


@contextmanager
def rows_held(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that computes rows once and gives them to be read any number of times within.

    They lie in compressed files of the shared folder, deleted at the end. Cached rows
    would go to the executors' disks uncompressed once memory is full, and what was
    shuffled for them would stay as long as they do.
    """
    folder, numbers = new_work_folder(spark, "held"), count()

    def hold(rows: DataFrame) -> DataFrame:
        path = f"{folder}/{next(numbers)}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    try:
        yield hold
    finally:
        delete_folder(spark, folder)
