"""Kept verdicts as a table of buckets, one verdict for each key, whatever fails while it is written.

A generation is a folder that is written whole and never changed. A small file names the current one; a new
generation counts only once that file is replaced, at one stroke. A run that is killed before leaves a folder
that nothing reads, and repeated it gives the same verdicts. Rows lie in buckets of their key, so lookups
leave them where they are and send only what is asked for.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICTS = "rule_hash string, chunk_id string, model string, verdict string, evidence string"
KEY = ["rule_hash", "chunk_id", "model"]
MANIFEST = "current.json"


class VerdictStore:
    """A folder of generations. buckets holds for a store's first generation; later ones have as many."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _file_system(self, name: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def current(self) -> dict | None:
        """The current generation: its number, folder and buckets; None before the first."""
        fs, place = self._file_system(MANIFEST)
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, told: dict, before: dict | None) -> None:
        """Replace the file that names the current generation, unless another writer has done so."""
        if (self.current() or {}).get("folder") != (before or {}).get("folder"):
            raise RuntimeError(f"{self.path} was changed by another writer; nothing was kept")
        fs, place = self._file_system(MANIFEST)
        _, draft = self._file_system(f".{MANIFEST}-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(told).encode()))
        finally:
            out.close()
        if fs.exists(place):
            fs.delete(place, False)  # rename doesn't replace everywhere; until it is done the draft is there to be named by hand
        if not fs.rename(draft, place):
            raise RuntimeError(f"{place} could not be written")

    def read(self) -> DataFrame:
        """All kept verdicts, in the buckets of their keys."""
        now = self.current()
        if now is None:
            return self.spark.createDataFrame([], VERDICTS)
        name = f"rulegrain_verdicts_{now['folder'].replace('-', '_')}"
        # the session's catalog has to know of the buckets
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({VERDICTS}) USING parquet CLUSTERED BY ({', '.join(KEY)}) INTO {now['buckets']} BUCKETS LOCATION '{self.path}/{now['folder']}'")
        return self.spark.table(name)

    def keep(self, new: DataFrame) -> int:
        """Add verdicts whose keys aren't there yet; of several with one key the first by verdict and evidence. Returns the generation's number."""
        before = self.current()
        buckets = before["buckets"] if before else self.buckets
        rows = new.select(*(c.split()[0] for c in VERDICTS.split(", "))).filter(" and ".join(f"{k} is not null" for k in KEY))
        fresh = rows.groupBy(*KEY).agg(F.min(F.struct("verdict", "evidence")).alias("v")).select(*KEY, "v.*")
        old = self.read()
        whole = old.unionByName(fresh.join(old.select(*KEY), KEY, "left_anti"))
        told = {"generation": (before["generation"] if before else 0) + 1, "folder": f"gen-{uuid.uuid4().hex}", "buckets": buckets}
        name = f"rulegrain_verdicts_{told['folder'].replace('-', '_')}"
        whole.repartition(buckets, *KEY).write.format("parquet").bucketBy(buckets, *KEY).option("path", f"{self.path}/{told['folder']}").saveAsTable(name)
        self._commit(told, before)
        return told["generation"]
