"""The concept registry as streaming state: the fold of ``operators.registry``, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.registry import FOLDED, HALF, MOST, START, Registry, in_order


class _Fold(StatefulProcessor):
    """Of a run: its concepts and their vectors, a list that only grows. A batch reads the list once
    and appends what it mints."""

    def __init__(self, *gate: float):
        self.gate = gate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.concepts = handle.getListState("concepts", "concept string, vector array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        registry, out = Registry(*self.gate), []
        for concept, vector in self.concepts.get() if self.concepts.exists() else ():
            registry.add(concept, vector)
        known = len(registry.names)
        for section, own in in_order(pd.concat(list(rows))):
            out += registry.commit(key[0], section, own)
        if new := registry.names[known:]:
            self.concepts.appendList([(c, registry.matrix[known + i].tolist()) for i, c in enumerate(new)])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOLDED.split(", ")])

    def close(self) -> None:
        pass


def gate_stream(assignments: DataFrame, start: float = START, most: float = MOST, half: float = HALF) -> DataFrame:
    """``gate_fold`` of a stream whose batches follow one another in ``ord`` and do not cut a section.
    The session needs the settings in ``streaming.watch.STORE``; a restart goes on from the checkpoint."""
    return assignments.groupBy("run").transformWithStateInPandas(_Fold(start, most, half), outputStructType=FOLDED, outputMode="Append", timeMode="None")
