"""Scenes as a stream against a static model index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import features as f
from ..operators.clouds import sample_uniform


def match_stream(scenes: DataFrame, model: DataFrame, cfg: f.MatchConfig, path: str, checkpoint: str) -> StreamingQuery:
    """Write pose hypotheses of each micro-batch of whole scenes to `path`.

    A batch's folder is overwritten when the batch is run again, so each scene counts once.
    """
    index = f.train(model, cfg).cache()

    def batch(scene: DataFrame, number: int) -> None:
        refs = sample_uniform(scene, cfg.scene_step)
        acc = f.votes(f.pairs(scene, cfg, refs), index, cfg, best=True)
        out = f.hypotheses(f.best_votes(acc), scene, model, cfg)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scenes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
