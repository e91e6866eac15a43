"""Prompt hints over a stream: each prompt event is joined with the registers. An addition of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.operators import hints

PROMPT = "prompt_id string, prompt string"


def prompt_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PROMPT).json(path)


def write_hints(prompts: DataFrame, registers: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Hints of each micro-batch; a prompt is whole within its batch, so no state is kept."""

    def batch(df: DataFrame, epoch: int) -> None:
        hints.hints(df, registers).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return prompts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
