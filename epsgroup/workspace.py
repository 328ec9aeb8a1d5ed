"""Tables a job writes between its steps, in the shared folder the session names."""

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Workspace:
    """A folder of Parquet tables. Written steps cut lineage and outlive lost executors.

    The folder lies in `root`, else in `spark.checkpoint.dir`, else in the warehouse, which all executors share.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        root = root or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        self.path = f"{root.rstrip('/')}/epsgroup-{uuid.uuid4().hex}"

    @classmethod
    def existing(cls, spark: SparkSession, path: str) -> "Workspace":
        """The workspace another run left at this path."""
        ws = cls(spark, "unused")
        ws.path = path.rstrip("/")
        return ws

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write the table once and read it back."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def save_step(self, df: DataFrame, name: str, step: int) -> None:
        """Write one step of a table that grows step by step."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/step={step}")

    def steps(self, name: str, schema: T.StructType) -> DataFrame:
        """All steps of such a table, with their number in the column `step`."""
        full = T.StructType([*schema.fields, T.StructField("step", T.IntegerType())])
        return self.spark.read.schema(full).parquet(f"{self.path}/{name}")

    def written_steps(self, name: str) -> list[int]:
        """The numbers of the steps of such a table that were written to their end, up to the first that was not."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = []
        while files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/step={len(done)}/_SUCCESS")):
            done.append(len(done))
        return done

    def release(self) -> None:
        """Let Spark delete the shuffle files of jobs that have ended: it does so once the driver has collected what refers to them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def discard(self, *names: str) -> None:
        """Delete the named tables, or the whole folder. What still reads from them must be written elsewhere before."""
        jvm = self.spark.sparkContext._jvm
        for name in names or ("",):
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
