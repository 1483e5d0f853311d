"""New packages as a stream: each micro-batch of files is judged as a whole and appended. Packages must arrive whole in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from riskweave.plans.analyze import analyze

COLUMNS = ("skill_id", "verdict", "category", "score", "layer", "condition", "evidence_text")


def judge_stream(files: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Verdicts of a stream of ``files(skill_id, rel, text)`` as Parquet, a folder a batch: a batch that is run again overwrites its
    own folder, so each package is written once. Runs through what is there, then ends."""

    def write(batch: DataFrame, number: int) -> None:
        analyze(batch).select(*COLUMNS).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
