"""Learning from a stream: a log of what each micro-batch changes, merged when it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.operators import memory
from engrama.settings import Settings
from engrama.sources.shared import delete, move, names_in
from engrama.streaming.events import deliver

#: Changes after which they are merged into one.
COMPACT = 20
PAIRS, NOTES, META = f"note_a {{0}}, note_b {{0}}, {memory.PAIR_STATE}, batch long", "id {0}, c long, batch long", "queries long, batch long"


class LearningLog:
    """What has been learned, in a folder per batch that is moved into place whole.

    A batch's folder holds the pairs and notes that it touched, as they are
    after it; of each key the last batch counts. Folders are merged now and then. So a batch writes as much as it
    touches, however much is known already, and one that is delivered twice changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "string", settings: Settings = Settings()):
        self.spark, self.folder, self.kind, self.settings = spark, folder, id_type, settings

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n[len(kind) + 1 :]) for n in names_in(self.spark, self.folder) if n.startswith(f"{kind}-"))

    def held(self) -> list[str]:
        """The folders that count: the last merged one, and those of later batches."""
        merged = self._numbers("merged")[-1:]
        return [*(f"merged-{n}" for n in merged), *(f"batch-{n}" for n in self._numbers("batch") if not merged or n > merged[0])]

    def last(self) -> int:
        """The last batch that is in; -1 for none."""
        return max((int(n.split("-")[1]) for n in self.held()), default=-1)

    def _read(self, name: str, schema: str, keys: list[str], values: list[str]) -> DataFrame:
        held = [f"{self.folder}/{n}/{name}" for n in self.held()]
        schema = schema.format(self.kind)
        rows = self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")

    def state(self) -> tuple[DataFrame, DataFrame, int]:
        """Pairs, notes and the number of queries, by the last batch that touched each."""
        pairs = self._read("pairs", PAIRS, ["note_a", "note_b"], ["f", "w", "idle", "cab"])
        notes = self._read("notes", NOTES, ["id"], ["c"])
        queries = self._read("meta", META, [], ["queries"]).first()["queries"] if self.held() else 0
        return pairs, notes, queries or 0

    def synapses(self) -> DataFrame:
        """note_a, note_b, frequency, weight as of now."""
        return memory.weights_now(*self.state(), self.settings)

    def _write(self, name: str, batch: int, pairs: DataFrame, notes: DataFrame, queries: int) -> None:
        at = f"{self.folder}/.writing-{uuid.uuid4().hex}"
        number = F.lit(batch).cast("long").alias("batch")
        pairs.select("note_a", "note_b", "f", "w", "idle", "cab", number).write.parquet(f"{at}/pairs")
        notes.select("id", "c", number).write.parquet(f"{at}/notes")
        self.spark.createDataFrame([(queries, batch)], META).coalesce(1).write.parquet(f"{at}/meta")
        move(self.spark, at, f"{self.folder}/{name}-{batch}")

    def learn(self, log: DataFrame, batch: int) -> None:
        """Add the queries of a batch (seq, id, score, source), unless that batch or a later one is in already."""
        if batch <= self.last() or log.isEmpty():
            return
        self._write("batch", batch, *memory.fold(log, self.state(), self.settings))
        if len(self.held()) > COMPACT:
            self.compact()

    def compact(self) -> None:
        """One folder for all batches; the old ones go once it is in place and counts."""
        last = self.last()
        if last in self._numbers("merged") or last < 0:
            return
        self._write("merged", last, *self.state())
        for kind, n in [("batch", n) for n in self._numbers("batch") if n <= last] + [("merged", n) for n in self._numbers("merged") if n < last]:
            delete(self.spark, f"{self.folder}/{kind}-{n}")


def learn_stream(stream: DataFrame, log: LearningLog, checkpoint: str):
    """Each micro-batch of queries (seq, id, score, source) into the log."""
    return deliver(stream, lambda batch, number: log.learn(batch.select("seq", "id", "score", "source"), number), checkpoint)
