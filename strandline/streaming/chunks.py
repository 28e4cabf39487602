"""Streams of reads: each micro-batch is one chunk, aligned as a whole and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.align import Aligner


def align_stream(reads: DataFrame, targets: DataFrame, path: str, checkpoint: str, aligner: Aligner | None = None, paired: bool = False, trigger: dict | None = None):
    """Starts a query that aligns a stream of reads (id, name, seq, ...) and writes Parquet by batch; a batch that is run
    again replaces what it wrote. Insert sizes are those of the batch."""
    aligner = aligner or Aligner()
    work: Callable = aligner.align_pairs if paired else aligner.align

    def batch(df: DataFrame, number: int) -> None:
        work(df, targets).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
