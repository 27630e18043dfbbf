"""Settings of the detection pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

# They must equal the published pipeline for its results to be reproduced.
DEFAULT_DEPTH = 4
DEFAULT_WIDTH = 512
DEFAULT_MAX_WINDOWS = 120
THRESHOLD_LOOKBACK = 5
LATENCY_THRESHOLD_Q = 0.95
IAT_THRESHOLD_Q = 0.10
IAT_HEAD_BINS = 2
LATENCY_TAIL_BINS = 2
Z_SHORT_ROWS = 7
Z_LONG_ROWS = 21
Z_MIN_ROWS = 5
MAD_SCALE = 1.4826
MAD_FLOOR = 1e-6
RUN_THRESHOLD = 0.8
RUN_CAP = 9
EWMA_ALPHA = 0.3
ACTIVE_MBPS = 1e-6
MAX_QID = 7
QIDS_PER_SWITCH = 8
COLOR_GREEN, COLOR_YELLOW, COLOR_RED = 0, 1, 3
DEFAULT_QUEUE = 7
NON_TUNNEL_QUEUE = 4
REQUEUE_QUEUE = 7
QFI_TO_QUEUE = {1: 0, 2: 5, 3: 2, 4: 4, 5: 1, 6: 6, 7: 3, 8: 7, 9: 7}

# Rows summed at once for the exponential average, and how many such units can count: 0.7**(40 * 128) times the largest
# double is less than half of the smallest, so what lies further back adds exactly 0.
EWMA_UNIT = 128
EWMA_UNITS = 40
EWMA_ROWS = EWMA_UNIT * EWMA_UNITS


@dataclass(frozen=True)
class SketchGeometry:
    """Shape of one sketch: hash rows, buckets per row, histogram bins, and how flows are addressed.

    ``hashing`` is ``crc32``, which flow queries use by default, or ``switch``, the addressing of register dumps.
    """

    depth: int = DEFAULT_DEPTH
    width: int = DEFAULT_WIDTH
    lat_bins: int = 8
    iat_bins: int = 8
    hashing: str = "crc32"

    @property
    def lat_columns(self) -> list[str]:
        return [f"lat{i}" for i in range(self.lat_bins)]

    @property
    def iat_columns(self) -> list[str]:
        return [f"iat{i}" for i in range(self.iat_bins)]

    @property
    def measures(self) -> list[str]:
        return self.lat_columns + self.iat_columns + COUNTERS


@dataclass(frozen=True)
class BinEdges:
    """Histogram edges per queue: one entry per queue of a switch. Lookups are SQL text."""

    lat: dict[int, tuple[float, ...]]
    iat: dict[int, tuple[float, ...]]

    def latency(self, qid: str) -> str:
        """Latency edges of the queue in column ``qid``, null for an unknown queue."""
        return self._lookup(self.lat, qid)

    def arrival(self, qid: str) -> str:
        """Inter-arrival edges of the queue in column ``qid``, null for an unknown queue."""
        return self._lookup(self.iat, qid)

    @staticmethod
    def _lookup(edges: dict[int, tuple[float, ...]], qid: str) -> str:
        entries = [f"{q}, array({', '.join(f'{e!r}D' for e in es)})" for q, es in edges.items()]
        return f"try_element_at(map({', '.join(entries)}), CAST({qid} AS INT))"


COUNTERS = ["pkt_cnt", "byte_cnt", "green_cnt", "yellow_cnt", "drop_cnt"]


@dataclass(frozen=True)
class PipelineConfig:
    """Everything a detection run needs besides its input tables.

    ``run`` names the columns that tell series of several devices or recordings apart; each is detected as if it were alone.
    """

    geometry: SketchGeometry = field(default_factory=SketchGeometry)
    window_secs: float = 1.0
    # Windows per slice: the unit in which a long per-key series is counted before it is cut into blocks.
    slice_windows: int = 4096
    # Rows per block of a per-key series; one block is one unit of work for a window function.
    block_rows: int = 4096
    # Class features are rounded here so that the order in which Spark sums doubles cannot
    # decide whether a median absolute deviation is zero.
    feature_decimals: int = 12
    thr_global: float = 0.5
    thr_map: dict[int, float] = field(default_factory=dict)
    debounce_k: int = 1
    debounce_h: float = 1.0
    run: tuple[str, ...] = ()
