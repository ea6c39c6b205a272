"""The folder that the cluster shares for what is computed once."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.  Where it is unset, one is made in local mode only (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return str(context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def held(df: DataFrame) -> DataFrame:
    """``df``, computed once: written to the shared folder and read back, so that a lost executor costs no recomputation; deleted when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/held-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Files:
    """Small marker files beside tables, in whatever file system holds them.  Creating one that exists fails: the first of several writers wins."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.conf, self.folder = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder.rstrip("/")

    def _at(self, name: str) -> tuple:
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        path, system = self._at(name)
        return system.exists(path)

    def delete(self, name: str) -> None:
        path, system = self._at(name)
        system.delete(path, True)

    def names(self, name: str) -> list[str]:
        path, system = self._at(name)
        return [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []

    def create(self, name: str, content: dict) -> bool:
        """Whether this call made the file, with ``content`` as JSON."""
        path, system = self._at(name)
        if system.exists(path):
            return False
        try:
            out = system.create(path, False)
        except Exception as e:  # the file system's own exception comes wrapped
            if "already exists" in str(e).lower():
                return False
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return True

    def read(self, name: str) -> dict:
        path, system = self._at(name)
        stream = system.open(path)
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()


class VersionedTable:
    """A small control table whose every version is a folder and a numbered marker: a writer names the version that it has read, and loses if another was first."""

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.files, self.schema = spark, Files(spark, folder), StructType.fromDDL(schema)

    def read(self) -> tuple[int, DataFrame]:
        """The number of the last version (0: none yet) and its rows."""
        last = max((int(n) for n in self.files.names("versions") if n.isdigit()), default=0)
        if not last:
            return 0, self.spark.createDataFrame([], self.schema)
        return last, self.spark.read.schema(self.schema).parquet(f"{self.files.folder}/{self.files.read(f'versions/{last:010d}')['data']}")

    def commit(self, read: int, rows: DataFrame) -> bool:
        """Make ``rows`` the version after ``read``; false, and nothing changed, if there is one already."""
        data = f"data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.files.folder}/{data}")
        if self.files.create(f"versions/{read + 1:010d}", {"data": data}):
            return True
        self.files.delete(data)
        return False

    def update(self, change: object, attempts: int = 20) -> DataFrame:
        """Read, ``change(rows)``, write; again from what another writer has put there meanwhile, until it is the first.  A failing read or change writes nothing."""
        for _ in range(attempts):
            version, rows = self.read()
            if self.commit(version, change(rows)):
                return self.read()[1]
        raise RuntimeError(f"{self.files.folder}: other writers were first {attempts} times")
