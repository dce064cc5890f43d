"""Tables that are replaced without a gap.

Each load writes a folder of its own below the table's; an empty pointer file, created last and never changed, makes it the
current one. Readers open the folder that the newest pointer names, so they see the rows from before or those from after a
load, whole, and a load that fails has changed nothing. Folders that no reader should hold any more expire by age.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

POINTERS, PREFIX = "_punteros", "v-"


@dataclass(frozen=True)
class Version:
    """One load: its place in the sequence, its folder, and when it became current (seconds since 1970)."""

    number: int
    name: str
    since: float


class VersionedTable:
    """Names on a Hadoop file system; creating an empty file is atomic on all of them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[tuple[str, float]]:
        at = self._at(path)
        if not self._fs.exists(at):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(at)]

    def versions(self) -> list[Version]:
        """The loads that are still pointed to, oldest first; the last one is current."""
        found = [(name.partition("."), since) for name, since in self._list(f"{self.path}/{POINTERS}") if name[:1].isdigit()]
        return sorted((Version(int(number), PREFIX + own, since) for (number, _, own), since in found), key=lambda v: (v.number, v.name))

    def current(self) -> str:
        """The folder to read."""
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"nothing has been loaded into {self.path}")
        return f"{self.path}/{versions[-1].name}"

    def read(self, schema: StructType | str | None = None) -> DataFrame:
        """The rows of the current load. What has been opened stays as it is until it expires."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.current())

    def write(self, df: DataFrame, partition_by: Sequence[str] = ()) -> str:
        """A folder of its own for the rows; no reader sees it yet."""
        name = PREFIX + uuid.uuid4().hex
        df.write.option("compression", "snappy").partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        return name

    def publish(self, name: str) -> None:
        """Make a written folder the current one. Of two loads that end together, one comes last for every reader."""
        versions = self.versions()
        number = versions[-1].number + 1 if versions else 1
        self._fs.create(self._at(f"{self.path}/{POINTERS}/{number:012d}.{name.removeprefix(PREFIX)}"), False).close()

    def reload(self, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        """Truncate and load in one step; the rows may come from the table itself."""
        self.publish(self.write(df, partition_by))

    def expire(self, age: float) -> int:
        """Delete the loads that ceased to be current over ``age`` seconds ago, and what loads that failed so long ago have left.

        ``age`` must be longer than any query or load takes. The number of folders deleted.
        """
        before, versions = time.time() - age, self.versions()
        # The pointer goes first, so that none names a folder that is gone.
        old = [v for v, following in zip(versions, versions[1:]) if following.since < before]
        for version in old:
            self._fs.delete(self._at(f"{self.path}/{POINTERS}/{version.number:012d}.{version.name.removeprefix(PREFIX)}"), False)
        kept = {v.name for v in versions} - {v.name for v in old}
        left = [name for name, since in self._list(self.path) if name.startswith(PREFIX) and name not in kept and since < before]
        for name in left:
            self._fs.delete(self._at(f"{self.path}/{name}"), True)
        return len(left)
