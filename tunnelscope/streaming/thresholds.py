"""Rolling thresholds with keyed state: the last five rows of each tunnel live in the state store, not in a table per batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import IAT_THRESHOLD_Q, LATENCY_THRESHOLD_Q, THRESHOLD_LOOKBACK

RECENT = "recent"
RECENT_SCHEMA = "lat double, iat double"
COLUMNS = {"window": "int", "qfi": "int", "teid": "bigint", "lat_p95_ms": "double", "iat_p10_us": "double", "thr_lat_ms": "double", "thr_iat_us": "double"}
OUTPUT = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())
# Keyed state needs the store that keeps several variables per key.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def percentile(values: list[float], q: float) -> float:
    """Percentile with linear interpolation between neighbours, as in the batch expression; 0 without values."""
    if not values:
        return 0.0
    ordered, position = sorted(values), (len(values) - 1) * q
    low = int(position)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (position - low)


class Thresholds(StatefulProcessor):
    """Steps a tunnel's rows of a micro-batch in window order; each is compared with the five before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState(RECENT, RECENT_SCHEMA)

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        held = [tuple(r) for r in self.recent.get()]
        own = pd.concat(list(rows)).sort_values("window", kind="stable")
        limits = []
        for lat, iat in zip(own["lat_p95_ms"].tolist(), own["iat_p10_us"].tolist(), strict=True):
            limits.append((percentile([r[0] for r in held], LATENCY_THRESHOLD_Q), percentile([r[1] for r in held], IAT_THRESHOLD_Q)))
            held = [*held, (lat, iat)][-THRESHOLD_LOOKBACK:]
        self.recent.put(held)
        own["thr_lat_ms"], own["thr_iat_us"] = [v[0] for v in limits], [v[1] for v in limits]
        yield own[list(COLUMNS)]

    def close(self) -> None:
        pass


def stream_thresholds(tunnels: DataFrame) -> DataFrame:
    """Tunnel rows (window, qfi, teid, lat_p95_ms, iat_p10_us) with their thresholds.

    Batches must come in window order (``windowstream.read_window_stream``). State per tunnel is five pairs of numbers; a batch holds at most its windows' rows of a
    tunnel. Set ``spark.sql.streaming.stateStore.providerClass`` to ``STATE_STORE`` first.
    """
    return tunnels.groupBy("qfi", "teid").transformWithStateInPandas(Thresholds(), OUTPUT, "append", "none")
