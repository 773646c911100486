"""The cache as a stream: micro-batches of a change log folded into keyed state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.cache import current

STATE = "applied_pos long, payload string, part int"


def guarded(updates: DataFrame) -> DataFrame:
    """Streaming: per entity the newest (applied_pos, payload, part), emitted whenever the offset guard lets it move."""
    import pandas as pd

    def fold(key, frames, state):
        best = state.get if state.exists else (-1, None, -1)
        moved = False
        for pdf in frames:
            if len(pdf):
                top = pdf.loc[pdf["pos"].idxmax()]
                if int(top["pos"]) > best[0]:
                    best, moved = (int(top["pos"]), top["payload"], int(top["part"])), True
        if moved:
            state.update(best)
            yield pd.DataFrame({"entity_key": [key[0]], "applied_pos": [best[0]], "payload": [best[1]], "part": [best[2]]})

    return updates.groupBy("entity_key").applyInPandasWithState(fold, "entity_key string, applied_pos long, payload string, part int", STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_end(spark: SparkSession, stream: DataFrame, root: str) -> DataFrame:
    """Runs the guarded cache over what the source has now; each micro-batch is written under its batch id, so a replay overwrites itself."""
    out, job = f"{root}/state", uuid.uuid4().hex
    query = (
        guarded(stream)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
        .trigger(availableNow=True)
        .queryName(f"cache_{job}")
        .start()
    )
    query.awaitTermination()
    moved = spark.read.parquet(out)
    return current(moved.select("entity_key", "payload", F.col("applied_pos").alias("pos"), F.col("part").cast("int").alias("part")))
