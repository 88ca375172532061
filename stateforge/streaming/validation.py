"""Validation while training: best score and stale counter of every run, as its evaluations arrive.

An extension of the batch fold `evaluation.early_stop`: the state of a run is its
history of (step, score), a short list, and the fold goes over it in the order of
steps; so evaluations that arrive late or twice (the last counts) leave the same state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "run string, best_score double, best_step long, stale_evaluations int, stopped boolean, evaluations int"
#: Spark's store for state of several kinds.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def folded(history: dict[int, float], min_delta: float, patience: int) -> tuple[float, int, int, bool]:
    """Best score, its step, evaluations since, and whether to stop; an improvement is measured against the last accepted best."""
    best, at, stale = float("-inf"), 0, 0
    for step in sorted(history):
        if history[step] >= best + min_delta:
            best, at, stale = history[step], step, 0
        else:
            stale += 1
    return best, at, stale, stale >= patience


class Following(StatefulProcessor):
    """The state of one run: a map from step to score."""

    def __init__(self, min_delta: float, patience: int):
        self.min_delta, self.patience = min_delta, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getMapState("history", "step long", "score double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for step, score in zip(part["step"], part["score"], strict=True):
                self.history.updateValue((int(step),), (float(score),))
        known = {k[0]: v[0] for k, v in self.history.iterator()}
        yield pd.DataFrame([(key[0], *folded(known, self.min_delta, self.patience), len(known))], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def followed(evaluations: DataFrame, *, min_delta: float, patience: int) -> DataFrame:
    """A stream of (run, step, score) to the state of each run that a batch touches (update mode)."""
    spark = evaluations.sparkSession
    spark.conf.set(*PROVIDER)
    return evaluations.select("run", "step", "score").groupBy("run").transformWithStateInPandas(statefulProcessor=Following(min_delta, patience), outputStructType=OUT, outputMode="Update", timeMode="None")
