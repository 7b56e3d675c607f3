"""Session set-up and the shared working folder."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_OWN = re.compile(r"^[a-z]+-[0-9a-f]{32}$")


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("usagemill")
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cpus))
    for key, value in (_DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local session may go without the setting: it then gets a temporary
    folder that is removed at exit. On a cluster a missing setting is an error,
    as a machine-local folder would be lost with its machine.
    """
    conf = spark.sparkContext.getConf()
    shared = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="usagemill-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df to the shared folder and return the written table.

    Cuts the lineage: a lost executor costs its running tasks, not the steps
    before. The table is columnar and compressed, so it is far smaller than an
    RDD checkpoint.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_forget, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """cut, and aggregates of the rows written, taken while they are written instead of in a job of their own."""
    seen = Observation()
    table = cut(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), label)
    return table, seen.get


class Manifest:
    """Numbered JSON documents in a folder; the newest says what is in force.

    A document is written under another name and renamed when it is complete, so
    readers never meet half of one. A table has one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder, self.version = spark, f"{path}/_manifest", 0

    def _at(self, name: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def newest(self) -> dict | None:
        p, fs = self._at("")
        if not fs.exists(p):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        self.version = max([0, *(int(n) for n in names if n.isdigit())])
        if not self.version:
            return None
        p, fs = self._at(str(self.version))
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, document: dict) -> None:
        (draft, fs), (final, _) = self._at(f"draft-{uuid.uuid4().hex}"), self._at(str(self.version + 1))
        if fs.exists(final):
            raise RuntimeError(f"{final.toString()} is there already: the table has another writer")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        if not fs.rename(draft, final):
            raise RuntimeError(f"{final.toString()} could not be put in place")
        self.version += 1


def sweep(spark: SparkSession, older_than_ms: int = 7 * 86_400_000) -> int:
    """Remove intermediate tables that drivers which were killed have left behind; returns how many.

    Only tables older than older_than_ms go, as other drivers may share the folder.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    now = spark._jvm.java.lang.System.currentTimeMillis()
    old = [s.getPath() for s in fs.listStatus(root) if _OWN.search(s.getPath().getName()) and now - s.getModificationTime() > older_than_ms]
    for p in old:
        fs.delete(p, True)
    return len(old)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)
    except Exception:  # the session may be gone already
        pass
