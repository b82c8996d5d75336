"""The measures of ``operators.watch`` as a stream, with state for each run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.watch import MEASURES, PACE, RECENT, clean

#: The state store that holds lists and maps.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Rows that leave a run's task at a time, and of which Python objects are made at a time.
ROWS_OUT = 10_000
_COLUMNS = [c.split()[0] for c in MEASURES.split(", ")]


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(event_id, ts, kind, section, minted, elapsed, concept) of a run's batch by (ts, event_id). Meanwhile a
    row is kept as numbers, of strings their place in a list of the distinct ones."""
    names = {"kind": {}, "concept": {}}
    parts, zone, unit = {c: [] for c in ("ts", "event_id", "section", "minted", "elapsed", *names)}, None, "ns"
    for t in rows:
        zone, unit = t["ts"].dt.tz, t["ts"].dt.unit
        parts["ts"].append(t["ts"].to_numpy("datetime64[us]").astype(np.int64))
        for c in ("event_id", "section", "minted", "elapsed"):
            parts[c].append(t[c].to_numpy())
        for c, known in names.items():
            codes, found = pd.factorize(t[c])
            parts[c].append(np.array([known.setdefault(x, len(known)) for x in found], np.int32)[codes])
    columns = {}
    for c in list(parts):
        columns[c] = np.concatenate(parts.pop(c))
    order, texts = np.lexsort((columns["event_id"], columns["ts"])), {c: np.array(list(known), object) for c, known in names.items()}
    for at in range(0, len(order), ROWS_OUT):
        some = {c: x[order[at : at + ROWS_OUT]] for c, x in columns.items()}
        stamps = pd.Series(some["ts"].astype("datetime64[us]").astype(f"datetime64[{unit}]"))
        stamps = stamps if zone is None else stamps.dt.tz_localize("UTC").dt.tz_convert(zone)
        strings = {c: texts[c][some[c]] for c in texts}
        yield from zip(some["event_id"].tolist(), stamps, strings["kind"], some["section"].tolist(), some["minted"].tolist(), some["elapsed"].tolist(), strings["concept"], strict=True)


class _Run(StatefulProcessor):
    """Of a run: totals as a value, the last finished sections as a list, and maps of the sections
    that had a retry and of the use of concepts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "done long, empty long, registry long, stop long, ts timestamp")
        self.recent = handle.getListState("recent", "section long, minted long, elapsed double")
        self.retried = handle.getMapState("retried", "section long", "n long")
        self.used = handle.getMapState("used", "concept string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, empty, registry, stop, before = self.totals.get() if self.totals.exists() else (0, 0, 0, 0, None)
        recent = list(self.recent.get()) if self.recent.exists() else []
        had: dict[int, bool] = {}

        def retried(section: int) -> bool:
            if section not in had:
                had[section] = self.retried.containsKey((section,))
            return had[section]

        out, used = [], {}
        for event_id, ts, kind, section, minted, elapsed, concept in _in_order(rows):
            silent = None if before is None else (ts - pd.Timestamp(before)) // pd.Timedelta(seconds=1)
            before = ts
            if kind == "empty":
                empty += 1
            elif kind == "retry":
                if not retried(section):
                    self.retried.updateValue((section,), (1,))
                    had[section] = True
            elif kind == "done":
                done, minted = done + 1, int(minted)
                registry += minted
                if concept not in used:
                    used[concept] = self.used.getValue((concept,))[0] if self.used.containsKey((concept,)) else 0
                used[concept] += 1
                stop = max(stop, used[concept])
                recent = [*recent[1 - RECENT :], (section, minted, elapsed)]
                times = sorted(x[2] for x in recent[-PACE:])
                pace = round((times[(len(times) - 1) // 2] + times[len(times) // 2]) / 2, 4)
                last = {x[0] for x in recent}
                out.append((key[0], event_id, ts, done, empty, registry, silent, sum(x[1] for x in recent), pace, stop, len(last), sum(map(retried, last))))
                if len(out) == ROWS_OUT:
                    yield pd.DataFrame(out, columns=_COLUMNS)
                    out = []
        self.totals.update((done, empty, registry, stop, pd.Timestamp(before).to_pydatetime()))
        self.recent.put([tuple(x) for x in recent])
        for concept, n in used.items():
            self.used.updateValue((concept,), (n,))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def measures(log: DataFrame) -> DataFrame:
    """As the batch form, for a stream whose batches follow one another in time. The session needs
    the settings in ``STORE``. A run's rows of one batch are sorted in one task, as
    numbers: some 100 bytes a row. What it finds leaves it in parts."""
    return clean(log).groupBy("run").transformWithStateInPandas(_Run(), outputStructType=MEASURES, outputMode="Append", timeMode="None")
