"""Written tables in the cluster's shared folder, and small helpers on columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset, as in tests on one machine, a temporary one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Public setting: the shuffle files of a query are deleted as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder so that a lost executor costs a reread, not a recomputation.

    Nothing reads the shuffle files of a plan whose result has been written, so they are deleted at its end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        return self.write_all([df], name)

    def write_all(self, parts: Iterable[DataFrame], name: str = "t") -> DataFrame:
        """One table of some parts of equal schema, written in turn."""
        path, self.n = f"{self.base}/{self.n}-{name}", self.n + 1
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            for df in parts:
                schema = df.schema
                df.write.mode("append").parquet(path)
        finally:
            self.spark.conf.unset(_CLEAN) if before is None else self.spark.conf.set(_CLEAN, before)
        self.paths.append(path)
        read = self.spark.read.schema(schema).parquet(path)
        read._written = path
        return read

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        self._delete([table._written for table in tables])

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Deletes all tables written so far but these."""
        keep = {table._written for table in tables}
        self._delete([path for path in self.paths if path not in keep])

    def _delete(self, paths: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in paths:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        self.paths = [path for path in self.paths if path not in paths]


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, taken by position of their first match, so that extra columns with clashing names do no harm."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def extended(df: DataFrame, keep: list[str], added: dict[str, str]) -> StructType:
    """The schema of the columns `keep` followed by new ones."""
    return StructType([*df.select(*keep).schema.fields, *[StructField(k, _parse(v)) for k, v in added.items()]])


def _parse(kind: str):
    return StructType.fromDDL(f"x {kind}")[0].dataType
