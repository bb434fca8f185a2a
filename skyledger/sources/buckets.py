"""A keyed state table in buckets, changed by batches that write no more than what they touch.

Rows lie in buckets by a hash of their key. A version is one small pointer file that lists, for every bucket, the folders (layers) whose rows make it up,
oldest first, and how far each stream has come. A batch adds one layer to the buckets that it touches; a bucket that would get too many layers is
compacted in that batch, others stay as they are. Data and progress become visible together, with the pointer, and a batch that has been
recorded is not played again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyledger.session import path_exists


@dataclass(frozen=True)
class Version:
    number: int = 0
    layers: dict[int, list[str]] = field(default_factory=dict)
    progress: dict[str, int] = field(default_factory=dict)
    marks: dict[str, float] = field(default_factory=dict)


class BucketStore:
    """State by key; `merge` turns the rows that all layers hold for the keys of some buckets into one row a key."""

    def __init__(self, spark: SparkSession, base: str, schema: StructType, key: Sequence[str], merge: Callable[[DataFrame], DataFrame],
                 buckets: int = 64, max_layers: int = 4):
        self.spark, self.base, self.schema, self.key, self.merge = spark, base.rstrip("/"), schema, list(key), merge
        self.buckets, self.max_layers = buckets, max_layers

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def version(self) -> Version:
        """The newest version; Version() if there is none. Pointers are numbered upwards, so the last name is the newest."""
        if not path_exists(self.spark, f"{self.base}/pointer"):
            return Version()
        fs, place = self._fs(f"{self.base}/pointer")
        names = sorted(s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().endswith(".json"))
        if not names:
            return Version()
        (text,) = self.spark.read.text(f"{self.base}/pointer/{names[-1]}", wholetext=True).first()
        got = json.loads(text)
        return Version(got["number"], {int(b): v for b, v in got["layers"].items()}, got["progress"], got["marks"])

    def _rows(self, layers: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.base}/layers/{folder}/bucket={b}" for b, folders in layers.items() for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def state(self, version: Version | None = None) -> DataFrame:
        """One row a key, of the newest or the given version."""
        return self.merge(self._rows((version or self.version()).layers))

    def _write(self, rows: DataFrame, number: int) -> tuple[str, list[int]]:
        """A new layer: its folder and the buckets that it has."""
        folder = f"{number:012d}-{uuid.uuid4().hex}"
        path = f"{self.base}/layers/{folder}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(path)
        fs, place = self._fs(path)
        found = [s.getPath().getName() for s in fs.listStatus(place)]
        return folder, [int(n.split("=")[1]) for n in found if n.startswith("bucket=")]

    def fold(self, rows: DataFrame, stream: str, epoch: int, marks: dict[str, float] | None = None, fresh: bool = False) -> Version:
        """Merge a batch into the state. `stream` and `epoch` name the batch: one that is recorded already changes nothing, while a batch of another stream
        (another checkpoint, say, which plays the log from its start) is always folded. `fresh` begins with an empty state. `marks` are numbers kept beside it.
        """
        now = self.version()
        if now.progress.get(stream, -1) >= epoch:
            return now
        number = now.number + 1
        layers = {} if fresh else {b: list(v) for b, v in now.layers.items()}
        folder, touched = self._write(self.merge(rows), number)
        for b in touched:
            layers.setdefault(b, []).append(folder)
        full = {b: layers[b] for b in touched if len(layers[b]) > self.max_layers}
        if full:
            compact, _ = self._write(self.merge(self._rows(full)), number)
            layers.update({b: [compact] for b in full})
        after = Version(number, layers, {**({} if fresh else now.progress), stream: epoch}, {**({} if fresh else now.marks), **(marks or {})})
        fs, place = self._fs(f"{self.base}/pointer/{number:012d}.json")
        # Created once: of two writers of one number the second fails.
        out = fs.create(place, False)
        try:
            out.write(bytearray(json.dumps(after.__dict__).encode()))
        finally:
            out.close()
        return after

    def unused(self) -> list[str]:
        """Folders of layers that the newest version does not need; they may go once no reader of an older version is left."""
        if not path_exists(self.spark, f"{self.base}/layers"):
            return []
        fs, place = self._fs(f"{self.base}/layers")
        used = {f for folders in self.version().layers.values() for f in folders}
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(place)) if n not in used)

    def vacuum(self) -> int:
        """Delete the unused layers and all pointers but the newest; the number of layers that went."""
        gone = self.unused()
        for name in gone:
            fs, place = self._fs(f"{self.base}/layers/{name}")
            fs.delete(place, True)
        newest = self.version().number
        fs, place = self._fs(f"{self.base}/pointer")
        for s in fs.listStatus(place) if path_exists(self.spark, f"{self.base}/pointer") else []:
            if s.getPath().getName() != f"{newest:012d}.json":
                fs.delete(s.getPath(), False)
        return len(gone)
