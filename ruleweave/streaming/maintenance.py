"""Programs over streams: each micro-batch adds facts, and what depends on them is computed again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..program import Program
from ..storage import scratch_path


class Maintained:
    """A relation of a program that follows a stream of facts.

    The facts of each batch are written to a folder of its number in ``folder`` (below the checkpoint, when a query is
    started), and relations are computed from what is in these folders. So a restart from the checkpoint finds the
    facts of all batches before, and a batch that Spark delivers twice replaces itself.
    """

    def __init__(self, program: Program, facts: str, relation: str, columns: Sequence[str] | None = None, folder: str | None = None) -> None:
        self.program, self.facts, self.name, self.columns, self.folder = program, facts, relation, columns, folder
        self.own = list(program.tables.get(facts, []))

    def _batches(self, upto: int) -> list[str]:
        """The folders of the whole batches up to a number."""
        spark = self.program.spark
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch=*/_SUCCESS")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        paths = [str(f.getPath().getParent().toString()) for f in found or []]
        return sorted(p for p in paths if int(p.rsplit("=", 1)[1]) <= upto)

    def on_batch(self, batch: DataFrame, number: int) -> DataFrame | None:
        """Take a batch in and return the relation as it is then; None if the batch is empty."""
        spark = self.program.spark
        self.folder = self.folder or scratch_path(spark, "facts")
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        if spark.read.schema(batch.schema).parquet(f"{self.folder}/batch={number}").isEmpty():
            return None
        self.program.tables[self.facts] = list(self.own)
        self.program.add_table(self.facts, spark.read.schema(batch.schema).parquet(*self._batches(number)))
        return self.program.relation(self.name, self.columns)

    def start(self, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
        """Follow a streaming DataFrame; ``sink`` gets the relation after each batch that changed its input."""
        self.folder = self.folder or f"{checkpoint.rstrip('/')}/facts"

        def each(batch: DataFrame, number: int) -> None:
            now = self.on_batch(batch, number)
            if now is not None:
                sink(now, number)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
