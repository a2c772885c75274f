"""Versioned state: one folder of Parquet tables per snapshot, and a pointer to the latest."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.operators.graph import incremental_update
from engrama.sources.shared import delete, move, names_in

SYNAPSES = "note_a string, note_b string, weight double, frequency double, last_coactivated timestamp, created timestamp"
QUALITY = "id string, score double, strong_ratio double, mean_weight double, frequency double, dormant boolean, dormant_cycles int, evaluated_at timestamp"
PHANTOMS = "source string, target string, similarity double"
META = "queries long, created timestamp, updated timestamp, consolidation_cycles int"
BATCHES = "stream string, batch long"
SCHEMAS = {"synapses": SYNAPSES, "node_quality": QUALITY, "phantom_links": PHANTOMS, "meta": META, "batches": BATCHES}
#: What names a row, where two writers' tables are merged; of the others the later writer's stays.
KEYS = {"synapses": ["note_a", "note_b"], "node_quality": ["id"], "phantom_links": ["source", "target"], "batches": ["stream"]}
#: Seconds without a sign of life after which a writer counts as dead; seconds that a writer waits for another one; old snapshots that stay readable.
LEASE, PATIENCE, KEPT = 300, 600, 5


class Store:
    """Snapshots under a folder of any file system that Spark knows.

    A snapshot is written whole and then named in the pointer table, so readers
    see the old state or the new one. A missing or unreadable pointer means an
    empty state.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.folder}/pointer").agg(F.max("version")).first()[0] or 0
        except Exception as e:  # no state yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return 0
            raise

    def load(self) -> dict[str, DataFrame]:
        version = self.version()
        if not version:
            return {name: self.spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
        return {name: self.spark.read.schema(schema).parquet(f"{self.folder}/v{version}/{name}") for name, schema in SCHEMAS.items()}

    @contextmanager
    def _alone(self) -> Iterator[None]:
        """Held by one writer at a time: a file that can only be created once."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/writer")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        until = time.monotonic() + PATIENCE
        while not fs.createNewFile(path):
            if not self._alive(fs, path):
                fs.delete(path, False)  # its writer has died; whoever creates the file next goes on
                continue
            if time.monotonic() > until:
                raise TimeoutError(f"{self.folder}/writer is held")
            time.sleep(0.1)
        ended = threading.Event()
        sign = threading.Thread(target=self._sign, args=(fs, path, ended), daemon=True)
        sign.start()
        try:
            yield
        finally:
            ended.set()
            sign.join()
            fs.delete(path, False)

    @staticmethod
    def _alive(fs, path) -> bool:
        """Whether the holder of the file has touched it of late, or has just gone."""
        if not fs.exists(path):
            return True
        return time.time() * 1000 - fs.getFileStatus(path).getModificationTime() < LEASE * 1000

    @staticmethod
    def _sign(fs, path, ended: threading.Event) -> None:
        while not ended.wait(LEASE / 5):
            fs.setTimes(path, int(time.time() * 1000), -1)

    def save(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """A new snapshot; tables that are not given are carried over.

        ``base`` is the version that the tables were made from. If another
        writer has saved since, rows that only it has are kept.
        """
        with self._alone():
            latest, old = self.version(), self.load()
            version = latest + 1
            for name in SCHEMAS:
                table = tables.get(name, old[name])
                if name in tables and name in KEYS and base is not None and base != latest:
                    own = table.select(*old[name].columns)
                    table = own.unionByName(old[name].join(own.select(*KEYS[name]), KEYS[name], "left_anti").select(*own.columns))
                elif name == "meta" and name in tables and base is not None and base != latest:
                    table = merged_meta(table, old[name])
                table.write.mode("overwrite").parquet(f"{self.folder}/v{version}/{name}")
            self.spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{self.folder}/pointer")
            for gone in names_in(self.spark, self.folder):
                if gone.startswith("v") and gone[1:].isdigit() and int(gone[1:]) <= version - KEPT:
                    delete(self.spark, f"{self.folder}/{gone}")
        return version


def merged_meta(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """One row: the larger number of queries and cycles, the earlier creation, and of the rest what memory says, else the disk."""
    both = memory.select(*disk.columns, F.lit(0).alias("r")).unionByName(disk.withColumn("r", F.lit(1)))
    return both.agg(F.max("queries").alias("queries"), F.min("created").alias("created"), F.min_by("updated", F.when(F.col("updated").isNotNull(), F.col("r"))).alias("updated"), F.max("consolidation_cycles").alias("consolidation_cycles"))


def cached_graph(spark: SparkSession, folder: str, documents: DataFrame, nodes_of: Callable[[DataFrame], DataFrame], links_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, raw links and changes (id, change) of ``documents`` (id, mtime, ...), of which only those are parsed that differ from the last call's.

    The graph lies in numbered folders, each moved into place whole; what a
    call leaves is the next one's cache. Without a cache all is parsed and new.
    """
    names = [n for n in names_in(spark, folder) if n.startswith("graph-")]
    last = max((int(n[6:]) for n in names), default=0)
    if last:
        read = lambda name: spark.read.parquet(f"{folder}/graph-{last}/{name}")
        nodes, links, changes = incremental_update(read("nodes"), read("links"), documents, nodes_of, links_of)
    else:
        nodes, links, changes = nodes_of(documents), links_of(documents), documents.select("id", F.lit("added").alias("change"))
    at = f"{folder}/.writing-{uuid.uuid4().hex}"
    for name, table in (("nodes", nodes), ("links", links), ("changes", changes)):
        table.write.parquet(f"{at}/{name}")
    move(spark, at, f"{folder}/graph-{last + 1}")
    for n in names:
        if int(n[6:]) < last:
            delete(spark, f"{folder}/{n}")
    return tuple(spark.read.parquet(f"{folder}/graph-{last + 1}/{name}") for name in ("nodes", "links", "changes"))
