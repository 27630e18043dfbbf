"""The same queries as plain SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

import re

from ..operators.rolling import ROLL_KEYS, Z_KEYS
from ..plans.standin import IAT_EDGES, LAT_EDGES, large_model

DEPTH, WIDTH = 3, 16


def fx(expr: str, decimals: int = 9) -> str:
    """Rounding as in the Spark queries."""
    s = f"1e{decimals}"
    return (
        f"(CASE WHEN abs({expr}) < 9e15 / {s} THEN floor(({expr}) * {s} + 5e-1) / {s} "
        f"ELSE ({expr}) END)"
    )


def fixed_columns(columns: list[str], decimals: int = 9) -> str:
    return ", ".join(f"{fx(c, decimals)} AS {c}" for c in columns)


def crc(n: str) -> str:
    """CRC-32 of the six bytes of ``n``, most significant byte first."""
    bits = f"list_transform(range(48), lambda i: ({n} >> CAST(8 * (5 - i // 8) + i % 8 AS INTEGER)) & 1)"
    step = (
        "lambda c, x: xor(c >> 1, CASE WHEN xor(c & 1, x) = 1 THEN 3988292384::BIGINT "
        "ELSE 0::BIGINT END)"
    )
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295::BIGINT)"


def crc16(n: str) -> str:
    """CRC-16, reflected and from zero, of the five bytes of ``n``, bit by bit."""
    bits = f"list_transform(range(40), lambda i: ({n} >> CAST(8 * (4 - i // 8) + i % 8 AS INTEGER)) & 1)"
    step = "lambda c, x: xor(c >> 1, CASE WHEN xor(c & 1, x) = 1 THEN 40961::BIGINT ELSE 0::BIGINT END)"
    return f"list_reduce(list_prepend(0::BIGINT, {bits}), {step})"


def edge_list(edges: list[int]) -> str:
    return "[" + ", ".join(f"{e}::DOUBLE" for e in edges) + "]"


def bin_of(value: str, edges: list[int]) -> str:
    return f"len(list_filter({edge_list(edges)}, lambda e: e <= {value}))"


def counted(column: str, prefix: str, extra: str = "true") -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {column} = {i} AND {extra}) AS {prefix}{i}" for i in range(8)
    )


BINS = [f"lat{i}" for i in range(8)] + [f"iat{i}" for i in range(8)]
COUNTERS = ["pkt_cnt", "byte_cnt", "green_cnt", "yellow_cnt", "drop_cnt"]
MEASURES = BINS + COUNTERS

FEATURES = [
    "feat_bw_mbps", "feat_pps", "feat_lat_p50_ms", "feat_lat_p95_ms", "feat_lat_tail_frac",
    "feat_lat_roll_p95_exceed_frac", "feat_iat_p10_us", "feat_iat_p50_us", "feat_iat_head_frac",
    "feat_iat_roll_p10_below_frac", "feat_yellow_frac", "feat_red_frac", "feat_teid_share",
    "feat_qfi_teid_count",
]
CLASS_COLUMNS = [
    "qfi_bw_total", "qfi_teid_hhi", "qfi_teid_top1_share", "qfi_teid_top2_share",
    "qfi_share_entropy", "qfi_frac_teids_active", "qfi_yellow_bw_share", "qfi_red_bw_share",
]
BASE = FEATURES + CLASS_COLUMNS

CTES: dict[str, str] = {}

CTES["packets"] = """
SELECT event_id AS packet_id, epoch_us(ts) AS ts_us,
  CAST((epoch_us(ts) - 1704067200000000) // 21600000000 AS INTEGER) AS "window",
  user_id % 8 AS teid,
  CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
    WHEN 'signup' THEN 4 ELSE 5 END AS qfi,
  CAST(floor(value * 1e5 + 5e-1) AS BIGINT) AS hop_latency_ns,
  CASE WHEN value < 60 THEN 0 WHEN value < 150 THEN 1 ELSE 3 END AS meter_color,
  64 + 13 * CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS packet_length,
  CASE WHEN value >= 60 AND value < 150 THEN 7 WHEN event_type = 'click' THEN 0
    WHEN event_type = 'error' THEN 5 WHEN event_type = 'purchase' THEN 2
    WHEN event_type = 'signup' THEN 4 ELSE 1 END AS egress_qid,
  ((epoch_us(ts) * 1024) // 1000000) & 281474976710655 AS ingress_tstamp_ns,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 5 WHEN 'purchase' THEN 2
    WHEN 'signup' THEN 4 ELSE 1 END AS class_queue
FROM events"""

CTES["cards"] = """
SELECT packet_id, 1 AS switch_id, hop_latency_ns & 4294967295 AS hop_latency, egress_qid,
  packet_length % 7 * (packet_id % 3) AS queue_depth, packet_id % 512 AS egress_port,
  packet_length % 512 AS ingress_port, teid + 4294960000 AS teid, qfi, meter_color, packet_length,
  packet_id * 400000 % 4294967296 AS drop_count, ingress_tstamp_ns AS sw_timestamp_ns,
  ts_us * 1000 AS host_timestamp_ns
FROM packets"""

CTES["flows"] = "SELECT DISTINCT teid, qfi FROM packets"

CTES["buckets"] = f"""
SELECT teid, qfi, r AS "row",
  CAST({crc('((r::BIGINT << 40) | (teid << 8) | qfi)')} % {WIDTH} AS INTEGER) AS bucket
FROM flows, range({DEPTH}) t(r)"""

SWITCH_BUCKETS = f"""
SELECT teid, qfi, r AS "row", CAST({crc16('((r::BIGINT << 38) | (teid << 6) | qfi)')} % {WIDTH} AS INTEGER) AS bucket
FROM flows, range({DEPTH}) t(r)"""

CTES["hits"] = f"""
SELECT p.*, b."row", b.bucket, (hop_latency_ns >> 10) & 65535 AS lat_q16,
  (ingress_tstamp_ns >> 10) & 4294967295 AS tick
FROM packets p JOIN buckets b USING (teid, qfi)"""

CTES["fwd"] = f"""
SELECT *, {bin_of('lat_q16', LAT_EDGES)} AS lat_bin,
  ((tick - coalesce(lag(tick) OVER (PARTITION BY egress_qid, "row", bucket
    ORDER BY ts_us, packet_id), 0)) & 4294967295) & 65535 AS iat
FROM hits WHERE meter_color <> 3"""

CTES["cells"] = f"""
SELECT "window", egress_qid AS qid, "row", bucket, {counted('lat_bin', 'lat')},
  {counted(bin_of('iat', IAT_EDGES), 'iat')},
  count(*) AS pkt_cnt, CAST(sum(packet_length) AS BIGINT) AS byte_cnt,
  count(*) FILTER (WHERE meter_color = 0) AS green_cnt,
  count(*) FILTER (WHERE meter_color <> 0) AS yellow_cnt
FROM fwd GROUP BY ALL"""

CTES["drops"] = """
SELECT "window", egress_qid AS qid, "row", bucket, count(*) AS drop_cnt
FROM hits WHERE meter_color = 3 GROUP BY ALL"""

CTES["sketch"] = f"""
SELECT "window", qid, "row", bucket,
  {', '.join(f'coalesce({m}, 0) AS {m}' for m in MEASURES)}
FROM cells FULL JOIN drops USING ("window", qid, "row", bucket)"""

CTES["flow_keys"] = 'SELECT DISTINCT "window", teid, qfi, egress_qid AS qid FROM packets'

CTES["recon"] = f"""
SELECT k."window", k.teid, k.qfi, k.qid,
  {', '.join(f'min(coalesce(s.{m}, 0)) AS {m}' for m in MEASURES)}
FROM flow_keys k JOIN buckets b USING (teid, qfi)
LEFT JOIN sketch s ON s."window" = k."window" AND s.qid = k.qid AND s."row" = b."row"
  AND s.bucket = b.bucket
GROUP BY ALL"""

LAT_LIST = "[" + ", ".join(f"lat{i}" for i in range(8)) + "]"
IAT_LIST = "[" + ", ".join(f"iat{i}" for i in range(8)) + "]"

CTES["weights"] = f"""
SELECT "window", qfi, teid, qid,
  CAST(CASE WHEN pkt_cnt > 0 THEN pkt_cnt ELSE list_sum({LAT_LIST}) END AS DOUBLE) AS w
FROM recon"""


def unrolled(source: str, key: str) -> str:
    """One row per histogram bin with its limits, running and total counts."""
    halves = [
        f"SELECT {key}, '{kind}' AS kind, i, CAST({lst}[i + 1] AS DOUBLE) AS n, "
        f"coalesce({edge_list(edges)}[i], 0) AS lo, {edge_list(edges)}[i + 1] AS hi "
        f"FROM {source}, range(8) t(i)"
        for kind, lst, edges in (("lat", LAT_LIST, LAT_EDGES), ("iat", IAT_LIST, IAT_EDGES))
    ]
    return f"""
SELECT *, sum(n) OVER (PARTITION BY {key}, kind ORDER BY i) AS cum,
  sum(n) OVER (PARTITION BY {key}, kind) AS tot
FROM ({' UNION ALL '.join(halves)})"""


def quant(q: str, kind: str) -> str:
    value = f"CASE WHEN n > 0 AND hi > lo THEN lo + (({q} * tot - (cum - n)) / n) * (hi - lo) ELSE lo END"
    return (
        f"coalesce(min_by({value}, i) FILTER (WHERE kind = '{kind}' AND tot > 0 "
        f"AND cum >= {q} * tot), 0)"
    )


CTES["bins_long"] = unrolled("recon", '"window", qfi, teid, qid')

CTES["queue_stats"] = f"""
SELECT "window", qfi, teid, qid, {quant('5e-1', 'lat')} / 1000 AS lat_p50_ms,
  {quant('95e-2', 'lat')} / 1000 AS lat_p95_ms,
  coalesce(sum(n / tot) FILTER (WHERE kind = 'lat' AND i >= 6 AND tot > 0), 0) AS lat_tail_frac,
  {quant('1e-1', 'iat')} AS iat_p10_us, {quant('5e-1', 'iat')} AS iat_p50_us,
  coalesce(sum(n / tot) FILTER (WHERE kind = 'iat' AND i < 2 AND tot > 0), 0) AS iat_head_frac
FROM bins_long GROUP BY ALL"""

STATS = ["lat_p50_ms", "lat_p95_ms", "lat_tail_frac", "iat_p10_us", "iat_p50_us", "iat_head_frac"]

CTES["tunnel_stats"] = f"""
SELECT "window", qfi, teid,
  {', '.join(f'coalesce(sum(w * {s}) FILTER (WHERE w > 0) / sum(w) FILTER (WHERE w > 0), 0) AS {s}' for s in STATS)}
FROM queue_stats JOIN weights USING ("window", qfi, teid, qid) GROUP BY ALL"""

CTES["thresholds"] = """
SELECT "window", qfi, teid,
  coalesce(quantile_cont(lat_p95_ms, 0.95) OVER w, 0) AS thr_lat_ms,
  coalesce(quantile_cont(iat_p10_us, 0.1) OVER w, 0) AS thr_iat_us
FROM tunnel_stats
WINDOW w AS (PARTITION BY qfi, teid ORDER BY "window" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""

ABOVE = "CASE WHEN lo >= {t} THEN 1e0 WHEN hi > {t} THEN (hi - {t}) / (hi - lo) ELSE 0e0 END"
BELOW = (
    "CASE WHEN hi <= {t} THEN 1e0 WHEN lo < {t} AND {t} < hi THEN ({t} - lo) / (hi - lo) "
    "ELSE 0e0 END"
)

CTES["crossings"] = f"""
SELECT "window", qfi, teid,
  coalesce(sum(w * n * {ABOVE.format(t='(thr_lat_ms * 1000)')} / tot) FILTER (WHERE kind = 'lat' AND w > 0 AND tot > 0), 0) AS over_w,
  coalesce(sum(w * n * {BELOW.format(t='thr_iat_us')} / tot) FILTER (WHERE kind = 'iat' AND w > 0 AND tot > 0), 0) AS under_w,
  coalesce(sum(w) FILTER (WHERE kind = 'lat' AND i = 0 AND w > 0), 0) AS whole
FROM bins_long JOIN weights USING ("window", qfi, teid, qid) JOIN thresholds USING ("window", qfi, teid)
GROUP BY ALL"""

CTES["counters"] = f"""
SELECT "window", qfi, teid, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTERS)}
FROM recon GROUP BY ALL"""

CTES["class_totals"] = """
SELECT "window", qfi, CAST(sum(green_cnt + yellow_cnt + drop_cnt) AS BIGINT) AS class_pkts,
  count(*) FILTER (WHERE green_cnt + yellow_cnt + drop_cnt > 0) AS active_teids
FROM counters GROUP BY ALL"""


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END"


CTES["features"] = f"""
SELECT "window", qfi, teid, byte_cnt * 8e0 / (216e2 * 1e6) AS feat_bw_mbps,
  pkt_cnt / 216e2 AS feat_pps, lat_p50_ms AS feat_lat_p50_ms, lat_p95_ms AS feat_lat_p95_ms,
  lat_tail_frac AS feat_lat_tail_frac, {ratio('over_w', 'whole')} AS feat_lat_roll_p95_exceed_frac,
  iat_p10_us AS feat_iat_p10_us, iat_p50_us AS feat_iat_p50_us,
  iat_head_frac AS feat_iat_head_frac, {ratio('under_w', 'whole')} AS feat_iat_roll_p10_below_frac,
  {ratio('yellow_cnt', '(green_cnt + yellow_cnt + drop_cnt)')} AS feat_yellow_frac,
  {ratio('drop_cnt', '(green_cnt + yellow_cnt + drop_cnt)')} AS feat_red_frac,
  {ratio('(green_cnt + yellow_cnt + drop_cnt)', 'class_pkts')} AS feat_teid_share,
  active_teids AS feat_qfi_teid_count
FROM counters JOIN tunnel_stats USING ("window", qfi, teid) JOIN crossings USING ("window", qfi, teid)
JOIN class_totals USING ("window", qfi)"""


def class_rollup(source: str, features: list[str]) -> str:
    """Roll-up of tunnel features, through each tunnel's share of its class."""
    parts = []
    for f in features:
        fn = "sum" if f.endswith(("_mbps", "_pps")) else "max" if f.endswith(("_ms", "_frac")) else "median"
        parts.append(f"{fx(f'CAST({fn}({f}) AS DOUBLE)', 12)} AS {f}")
    extras = {
        "qfi_bw_total": "sum(bw)",
        "qfi_teid_hhi": "sum(s * s)",
        "qfi_teid_top1_share": "max(s)",
        "qfi_teid_top2_share": "coalesce(max(s) FILTER (WHERE rk = 2), 0)",
        "qfi_share_entropy": "coalesce(-sum(s * ln(s)) FILTER (WHERE s > 0), 0)",
        "qfi_frac_teids_active": "count(*) FILTER (WHERE bw > 1e-6) / CAST(count(*) AS DOUBLE)",
        "qfi_yellow_bw_share": "CASE WHEN sum(bw) > 0 THEN sum(bw * feat_yellow_frac) / sum(bw) ELSE 0 END",
        "qfi_red_bw_share": "CASE WHEN sum(bw) > 0 THEN sum(bw * feat_red_frac) / sum(bw) ELSE 0 END",
    }
    parts += [f"{fx(sql, 12)} AS {name}" for name, sql in extras.items()]
    return f"""
SELECT "window", qfi, {', '.join(parts)}
FROM (SELECT *, row_number() OVER (PARTITION BY "window", qfi ORDER BY s DESC) AS rk FROM (
  SELECT *, feat_bw_mbps AS bw, CASE WHEN sum(feat_bw_mbps) OVER g > 0
    THEN feat_bw_mbps / sum(feat_bw_mbps) OVER g ELSE 0 END AS s
  FROM {source} WINDOW g AS (PARTITION BY "window", qfi)))
GROUP BY ALL"""


CTES["classes"] = class_rollup("features", FEATURES)

CTES["exact"] = """
SELECT "window", qfi, teid, count(*) FILTER (WHERE meter_color <> 3) AS pkt_cnt,
  CAST(sum(CASE WHEN meter_color = 3 THEN 0 ELSE packet_length END) AS BIGINT) AS byte_cnt,
  count(*) FILTER (WHERE meter_color = 0) AS green_cnt,
  count(*) FILTER (WHERE meter_color = 1) AS yellow_cnt,
  count(*) FILTER (WHERE meter_color = 3) AS drop_cnt
FROM packets GROUP BY ALL"""

CTES["exact_features"] = """
SELECT "window", qfi, teid, byte_cnt * 8e0 / (216e2 * 1e6) AS feat_bw_mbps,
  pkt_cnt / 216e2 AS feat_pps,
  CAST(yellow_cnt AS DOUBLE) / (green_cnt + yellow_cnt + drop_cnt) AS feat_yellow_frac,
  CAST(drop_cnt AS DOUBLE) / (green_cnt + yellow_cnt + drop_cnt) AS feat_red_frac,
  CAST(green_cnt + yellow_cnt + drop_cnt AS DOUBLE)
    / sum(green_cnt + yellow_cnt + drop_cnt) OVER g AS feat_teid_share,
  count(*) FILTER (WHERE green_cnt + yellow_cnt + drop_cnt > 0) OVER g AS feat_qfi_teid_count
FROM exact WINDOW g AS (PARTITION BY "window", qfi)"""

LIGHT = [
    "feat_bw_mbps", "feat_pps", "feat_yellow_frac", "feat_red_frac", "feat_teid_share",
    "feat_qfi_teid_count",
]
CTES["light_classes"] = class_rollup("exact_features", LIGHT)
CTES["odd_features"] = "SELECT * REPLACE (CASE WHEN teid % 3 = 1 THEN -qfi ELSE qfi END AS qfi) FROM exact_features"
CTES["odd_classes"] = class_rollup("odd_features", LIGHT)

CTES["hist"] = f"""
SELECT "window", qfi, {counted(bin_of('((hop_latency_ns >> 10) & 65535)', LAT_EDGES), 'lat')}
FROM packets GROUP BY ALL"""

CTES["hist_long"] = f"""
SELECT *, sum(n) OVER (PARTITION BY "window", qfi ORDER BY i) AS cum,
  sum(n) OVER (PARTITION BY "window", qfi) AS tot
FROM (SELECT "window", qfi, 'lat' AS kind, i, CAST({LAT_LIST}[i + 1] AS DOUBLE) AS n,
  coalesce({edge_list(LAT_EDGES)}[i], 0) AS lo, {edge_list(LAT_EDGES)}[i + 1] AS hi
  FROM hist, range(8) t(i))"""

CTES["series"] = """
SELECT "window", qfi, CAST(sum(packet_length) AS DOUBLE) AS x,
  row_number() OVER (PARTITION BY qfi ORDER BY "window") AS rn
FROM packets GROUP BY "window", qfi"""


WHOLE = '(PARTITION BY qfi ORDER BY "window" ROWS UNBOUNDED PRECEDING)'


def frame(rows: int) -> str:
    return f'(PARTITION BY qfi ORDER BY "window" ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)'


def z(x: str, rows: int) -> str:
    lst = f"list({x}) OVER {frame(rows)}"
    mad = f"list_aggregate({lst}, 'mad')"
    return (
        f"CASE WHEN count(*) OVER {frame(rows)} < 5 THEN 0 ELSE ({x} - median({x}) OVER {frame(rows)}) "
        f"/ ((CASE WHEN {mad} > 0 THEN {mad} ELSE 1e-6 END) * 14826e-4) END"
    )


def rolls(x: str) -> dict[str, str]:
    n = f"count(*) OVER {frame(5)}"
    position = 'row_number() OVER (PARTITION BY qfi ORDER BY "window")'
    return {
        "roll3_med": f"median({x}) OVER {frame(3)}",
        "roll5_med": f"median({x}) OVER {frame(5)}",
        "roll9_med": f"median({x}) OVER {frame(9)}",
        "roll5_max": f"max({x}) OVER {frame(5)}",
        "roll5_std": f"stddev_pop({x}) OVER {frame(5)}",
        "delta": f'{x} - coalesce(lag({x}) OVER (PARTITION BY qfi ORDER BY "window"), {x})',
        "ewma": f"list_reduce(list({x}) OVER {WHOLE}, lambda a, v: 3e-1 * v + 7e-1 * a)",
        "slope5": f"CASE WHEN {n} < 2 THEN 0 ELSE regr_slope({x}, rn) OVER {frame(5)} END",
    }


def run_of(zcol: str) -> str:
    return (
        f"least(9, rn - coalesce(max(CASE WHEN {zcol} < 8e-1 THEN rn END) OVER "
        '(PARTITION BY qfi ORDER BY "window" ROWS UNBOUNDED PRECEDING), 0))'
    )


def named_rolls(x: str) -> str:
    return ", ".join(f"{sql} AS {name}_{x}" for name, sql in rolls(x).items())


CTES["numbered"] = (
    'SELECT *, row_number() OVER (PARTITION BY qfi ORDER BY "window") AS rn FROM classes'
)
CTES["zs"] = f"""
SELECT *, {', '.join(f'{z(c, 21)} AS rz_{c}' for c in BASE)},
  {', '.join(f'{z(c, 7)} AS "zS_{c}"' for c in Z_KEYS)}, {', '.join(named_rolls(c) for c in ROLL_KEYS)}
FROM numbered"""
CTES["engineered"] = f"""
SELECT *, {', '.join(f'rz_{c} AS "zL_{c}", "zS_{c}" - rz_{c} AS "deltaSL_{c}", CAST({run_of("rz_" + c)} AS DOUBLE) AS runlen_hi_{c}' for c in Z_KEYS)}
FROM zs"""

ENGINEERED = (
    BASE
    + [f"rz_{c}" for c in BASE]
    + [f"{r}_{c}" for c in ROLL_KEYS for r in rolls("x")]
    + [f"{p}_{c}" for c in Z_KEYS for p in ("zS", "zL", "deltaSL", "runlen_hi")]
)

THRESHOLD = "CASE qfi WHEN 1 THEN 5e-1 WHEN 2 THEN 55e-2 WHEN 3 THEN 45e-2 ELSE 5e-1 END"


def stump(x: str, at: str, low: str, high: str) -> str:
    return f"(CASE WHEN CAST({x} AS FLOAT) < CAST({at} AS FLOAT) THEN {low} ELSE {high} END)"


CTES["full_scored"] = f"""
SELECT "window", qfi, score, {THRESHOLD} AS thr, CAST(score >= {THRESHOLD} AS INTEGER) AS pred
FROM (SELECT "window", qfi, 1e0 / (1e0 + exp(-(
  {stump('qfi_red_bw_share', '9e-2', '-12e-1', '14e-1')} + {stump('rz_qfi_bw_total', '8e-1', '-9e-1', '11e-1')}
  + CASE WHEN CAST(feat_lat_p95_ms AS FLOAT) < CAST(185e-1 AS FLOAT)
    THEN {stump('roll5_max_qfi_teid_hhi', '22e-2', '-6e-1', '3e-1')} ELSE 7e-1 END
  + {stump('"zS_qfi_yellow_bw_share"', '5e-1', '-5e-1', '8e-1')}
  + {stump('ewma_qfi_yellow_bw_share', '3e-1', '-4e-1', '9e-1')}))) AS score FROM engineered)"""

CTES["scored"] = f"""
SELECT "window", qfi, score, {THRESHOLD} AS thr, CAST(score >= {THRESHOLD} AS INTEGER) AS pred
FROM (SELECT "window", qfi, least(1e0, sum(CASE meter_color WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END)
  / CAST(count(*) AS DOUBLE)) AS score FROM packets GROUP BY ALL)"""


def latch(source: str) -> str:
    """Alarm state as the latest set or reset (k = 2, h = 0.8)."""
    return f"""
SELECT "window", qfi, score, thr, pred, CAST(coalesce(last_value(ev IGNORE NULLS) OVER
  (PARTITION BY qfi ORDER BY "window" ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS debounced
FROM (SELECT *, CASE WHEN sum(pred) OVER {frame(2)} >= 2 THEN 1 WHEN score < thr * 8e-1 THEN 0 END AS ev
  FROM {source})"""


CTES["event_rows"] = latch("scored")
CTES["full_event_rows"] = latch("full_scored")


def islands(source: str) -> str:
    return f"""
SELECT qfi, min("window") AS start_win,
  coalesce(any_value(next_off) - 1, (SELECT max("window") FROM {source})) AS end_win,
  max(score) AS peak_score, count(*) AS duration
FROM (SELECT *, sum(1 - debounced) OVER (PARTITION BY qfi ORDER BY "window") AS island,
  min(CASE WHEN debounced = 0 THEN "window" END) OVER (PARTITION BY qfi ORDER BY "window"
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_off FROM {source})
WHERE debounced = 1 GROUP BY qfi, island"""


CTES["episode_rows"] = islands("event_rows")
CTES["full_episode_rows"] = islands("full_event_rows")

CTES["runs"] = """
SELECT 'ep' || event_id AS episode_id, 'run_' || event_id || '.log' AS source, event_id, user_id,
  event_type, epoch_us(ts) * 1000 AS t0, lower(to_hex(user_id + 1)) AS a,
  lower(to_hex(user_id + 4096)) AS b, user_id % 9 + 1 AS q
FROM events"""

def tree_case(tree: dict, names: list[str], node: int = 0) -> str:
    """A tree as nested CASE; splits are compared in single precision."""
    if tree["left"][node] < 0:
        return f"{tree['value'][node]!r}e0"
    sides = (tree_case(tree, names, tree[side][node]) for side in ("left", "right"))
    return f"CASE WHEN CAST({names[tree['feature'][node]]} AS FLOAT) < CAST({tree['value'][node]!r}e0 AS FLOAT) THEN {' ELSE '.join(sides)} END"


CTES["watch_packets"] = """
SELECT packet_id, teid + 3232246784 AS src_addr, qfi + 3232246800 AS dst_addr, packet_id % 65536 AS src_port,
  packet_length % 4096 AS dst_port, packet_length, hop_latency_ns
FROM packets"""
CTES["watch"] = """
SELECT id AS entry_id, id + 3232246784 AS src_addr, id % 5 + 3232246801 AS dst_addr, id * 3 AS sp,
  CASE WHEN id % 2 = 0 THEN 0 ELSE 3 END AS spm, id * 16 AS dp, CASE WHEN id < 4 THEN 0 ELSE 16 END AS dpm
FROM range(6) t(id)"""
WATCH_ON = (
    "p.src_addr = w.src_addr AND p.dst_addr = w.dst_addr AND (p.src_port & w.spm) = (w.sp & w.spm) "
    "AND (p.dst_port & w.dpm) = (w.dp & w.dpm)"
)


def sql(select: str, ctes: dict[str, str] = CTES) -> str:
    """A query with the common table expressions it needs, in definition order."""
    needed: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for name in ctes:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                todo.append(ctes[name])
    parts = [f"{n} AS MATERIALIZED ({ctes[n]})" for n in ctes if n in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + select


WIRE = [
    "switch_id", "hop_latency", "egress_qid", "queue_depth", "egress_port", "ingress_port", "teid",
    "qfi", "meter_color", "packet_length", "drop_count", "sw_timestamp_ns",
]


def big(columns: list[str]) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


def hist_fraction(shape: str, value: str) -> str:
    return fx(f"sum(n * {shape.format(t=value)} / tot)")


ROLL_OUT = rolls("x")
KEY = '"window", qfi'
TKEY = '"window", qfi, teid'


def _events_per_type(cases: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN event_type = '{k}' THEN {v}" for k, v in cases.items())
    return f"CASE {whens} ELSE {otherwise} END"


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_sketch_windows"] = f'SELECT "window", qid, "row", bucket, {", ".join(MEASURES)} FROM sketch'
    q["scan_flow_keys"] = 'SELECT "window", teid, qfi, qid FROM flow_keys'
    q["distinct_flow_keys"] = q["scan_flow_keys"]
    q["window_numbers"] = (
        "SELECT event_id, CAST(CASE WHEN event_type IN ('click', 'error') THEN event_id ELSE -1 END "
        'AS INTEGER) AS "window" FROM events'
    )
    q["validate_bins"] = """
SELECT problem, count(*) AS n FROM (
  SELECT unnest([CASE WHEN event_type = 'signup' THEN 'queue is not an integer' END,
    CASE WHEN NOT (user_id < k AND (event_type = 'error' OR k < event_id)) THEN 'latency_us: not increasing' END,
    CASE WHEN NOT user_id < k THEN 'iat_us: not increasing' END]) AS problem
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)
  UNION ALL
  SELECT 'latency bin counts differ' FROM (SELECT count(DISTINCT event_type = 'error') AS c FROM events) WHERE c > 1)
WHERE problem IS NOT NULL GROUP BY problem"""
    q["bundle_thresholds"] = """
SELECT event_id, event_id % 3 + 1 AS qfi,
  CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN 55e-2 ELSE 5e-1 END AS thr, 2 AS k, 8e-1 AS h FROM events"""
    q["postcard_decode"] = f"SELECT packet_id, {big(WIRE)} FROM cards WHERE packet_id % 50 <> 7"
    q["postcard_records"] = f"SELECT packet_id, {big(WIRE + ['host_timestamp_ns'])} FROM cards"
    q["postcard_log_parse"] = (
        f"SELECT packet_id, {big(WIRE + ['host_timestamp_ns'])} FROM cards WHERE packet_id % 20 <> 3"
    )
    q["gtpu_decode"] = """
SELECT packet_id, CASE WHEN qfi <> 5 THEN (CASE WHEN qfi = 3 THEN 6 ELSE 17 END)::BIGINT END AS protocol,
  CASE WHEN qfi <> 5 THEN (CASE WHEN qfi = 4 THEN 53 ELSE 2152 END)::BIGINT END AS dst_port,
  CASE WHEN qfi IN (1, 2) THEN teid + 4294960000 ELSE 0 END AS teid,
  CASE WHEN qfi = 1 THEN 1 ELSE 0 END::BIGINT AS qfi FROM packets"""
    q["injection_log_parse"] = """
SELECT source, CASE WHEN event_type = 'purchase' THEN 'teid_impersonation' ELSE 'start' END AS event, episode_id,
  t0 AS ts_ns, CAST(CASE WHEN event_type <> 'purchase' AND event_id % 11 <> 0 THEN q END AS INTEGER) AS qfi,
  CASE WHEN event_type <> 'purchase' THEN '0x' || a || ',0x' || b END AS teids,
  CASE WHEN event_type = 'purchase' THEN '0x' || a || ',0x' || b END AS victims FROM runs
UNION ALL
SELECT source, CASE WHEN event_type = 'purchase' THEN 'teid_impersonation_end' ELSE 'stop' END, episode_id,
  t0 + user_id * 1000000, NULL, NULL, NULL FROM runs WHERE event_type <> 'view'"""
    # A view run has no stop and gets its planned duration; user 0 stops at its start, which an impersonation run may not.
    # Every eleventh run names no class and has the one asked for.
    planned, stopped = "(user_id % 5 + 20) * 1000000000", "user_id * 1000000"
    asked = "event_id % 11 = 0"
    burst = f"""t0 + 5000000 AS start_ns, t0 + CASE WHEN event_type = 'view' THEN {planned} ELSE {stopped} END + 5000000 AS end_ns,
  CAST(CASE WHEN {asked} THEN user_id % 3 + 1 ELSE q END AS VARCHAR) AS qfis, '0x' || a || ',0x' || b AS teids,
  '{{"duration_s":' || (user_id % 5 + 20) || '}}' AS params
FROM runs WHERE event_type <> 'purchase'"""
    q["episode_labels"] = f"SELECT 'congestion' AS anomaly_type, episode_id, {burst}"
    q["episode_labels_burst"] = f"SELECT 'microburst' AS anomaly_type, source, {burst}"
    q["episode_labels_abuse"] = f"""
SELECT 'policy_abuse' AS anomaly_type, source, t0 + 5000000 AS start_ns,
  t0 + CASE WHEN user_id = 0 THEN {planned} ELSE {stopped} END + 5000000 AS end_ns,
  CASE WHEN {asked} THEN CAST(user_id % 3 + 1 AS VARCHAR) WHEN q = 5 THEN '5' WHEN q < 5 THEN q || ',5' ELSE '5,' || q END AS qfis,
  '0x' || a || ',0x' || b AS teids,
  '{{"duration_s":' || (user_id % 5 + 20) || ',"victims":[{{"teid":"0x' || a || '",' || CASE WHEN {asked} THEN '' ELSE '"victim_qfi":5,' END
    || '"fake_qfi":4}},{{"teid":"0x' || b || '",' || CASE WHEN {asked} THEN '' ELSE '"victim_qfi":' || q || ',' END || '"fake_qfi":6}}]}}' AS params
FROM runs WHERE event_type = 'purchase'"""
    q["register_nonzero_topk"] = """
SELECT CAST(bucket + qid * 16 AS INTEGER) AS "index",
  CAST(sum(green_cnt) AS BIGINT) || ';' || CAST(sum(yellow_cnt) AS BIGINT) AS "value",
  CAST(sum(green_cnt + yellow_cnt) AS BIGINT) AS total
FROM cells WHERE "row" = 0 GROUP BY 1 ORDER BY total DESC, "index" LIMIT 20"""
    q["register_dump_csv"] = """
SELECT CAST(bucket + qid * 16 AS BIGINT) AS "index", CAST(sum(green_cnt) AS BIGINT) AS green, CAST(sum(yellow_cnt) AS BIGINT) AS yellow
FROM cells WHERE "row" = 1 GROUP BY 1 HAVING sum(green_cnt + yellow_cnt) > 0"""
    wide = [*LAT_EDGES, *(32000 + 4000 * i for i in range(1, 5))]
    bins = ", ".join(f"count(*) FILTER (WHERE b = {i})" for i in range(12))
    q["scan_wide_bins"] = sql(f"""
SELECT "window", qid, "row", bucket, array_to_string([{bins}], ',') AS lat
FROM (SELECT "window", egress_qid AS qid, "row", bucket, {bin_of('lat_q16', wide)} AS b FROM fwd) GROUP BY ALL""")
    q["clean_values"] = """
SELECT event_id, CASE WHEN bad THEN -1 WHEN event_id % 10 = 4 THEN 9007199254740993 + event_id ELSE CAST(trunc(value) AS BIGINT) END AS key,
  CASE WHEN bad THEN 0 WHEN event_id % 10 = 4 THEN CAST(9007199254740993 + event_id AS DOUBLE) ELSE value END AS feature
FROM (SELECT *, event_type IN ('click', 'error', 'view') OR event_id % 10 = 3 AS bad FROM events)"""
    q["postcard_qdepth_filter"] = (
        "SELECT packet_id, queue_depth, packet_length FROM cards WHERE queue_depth > 0"
    )
    q["postcard_port_filter"] = (
        "SELECT packet_id, 4567 AS dst_port FROM packets WHERE qfi NOT IN (3, 5) AND packet_id % 2 = 0"
    )
    q["watchlist_semi"] = f"""
SELECT packet_id, hop_latency_ns & 4294967295 AS hop_latency, packet_length - 4 AS report_length
FROM watch_packets p WHERE EXISTS (SELECT 1 FROM watch w WHERE {WATCH_ON})"""
    q["watchlist_counters"] = f"""
SELECT entry_id, count(p.packet_id) AS packets, CAST(coalesce(sum(packet_length), 0) AS BIGINT) AS bytes
FROM watch w LEFT JOIN watch_packets p ON {WATCH_ON} GROUP BY entry_id"""
    q["watchlist_overlaps"] = """
WITH p AS MATERIALIZED (SELECT event_id AS id, user_id % 8 AS teid, event_type, event_id % 65536 AS sp,
    (64 + 13 * CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT)) AS bytes FROM events),
w AS MATERIALIZED (SELECT id * 5 + v AS entry_id, teid, event_type, sp, bytes % 4096 AS dp, (id * 7919 + v * 104729) % 1000 AS priority,
    [65535, 65280, 0, 65535, 0][v + 1] AS spm, [65535, 65535, 65520, 0, 0][v + 1] AS dpm FROM p, range(5) t(v)),
h AS (SELECT p.id, any_value(p.bytes) AS bytes, arg_min(w.entry_id, w.priority * 1000000000 + w.entry_id) AS entry_id
  FROM p JOIN w ON p.teid = w.teid AND p.event_type = w.event_type AND (p.sp & w.spm) = (w.sp & w.spm)
    AND (p.bytes % 4096 & w.dpm) = (w.dp & w.dpm) GROUP BY p.id)
SELECT w.entry_id, count(h.id) AS packets, CAST(coalesce(sum(h.bytes), 0) AS BIGINT) AS bytes
FROM w LEFT JOIN h USING (entry_id) GROUP BY w.entry_id"""
    q["range_bin_overlaps"] = sql("""
SELECT packet_id, CAST(coalesce((
  SELECT arg_min(bin, priority * 1000000000000 + lo * 10000000 + hi * 10 + bin) FROM (
    SELECT (l_orderkey + l_linenumber) % 6 AS qid, (l_orderkey * 131 + l_linenumber * 7919) % 60000 AS lo, l_linenumber % 8 AS bin,
      (l_orderkey * 131 + l_linenumber * 7919) % 60000 + CAST(trunc(l_quantity) AS BIGINT) * 20 AS hi, l_partkey % 1000 AS priority
    FROM lineitem) r
  WHERE r.qid = egress_qid AND r.lo <= v AND v <= r.hi), 7) AS INTEGER) AS lat_bin
FROM (SELECT packet_id, egress_qid, (hop_latency_ns >> 10) & 65535 AS v FROM packets)""")
    q["quantised_fields"] = """
SELECT packet_id, ((hop_latency_ns * 1000) >> 10) & 65535 AS lat_q16,
  (((ingress_tstamp_ns >> 10) & 4294967295) - packet_id * 1000) & 65535 AS iat_q16,
  (((packet_id + 4000) << 4) & 65535) | ((qfi + 12) & 15) AS flow_idx,
  packet_id % 512 + CASE WHEN packet_length % 11 <= 7 THEN packet_length % 11 * 512 ELSE 0 END AS bucket_qidx
FROM packets"""
    q["hist_binning"] = f'SELECT "window", qfi, {", ".join(f"lat{i}" for i in range(8))} FROM hist'
    q["range_bin_join"] = f"""
SELECT packet_id, CAST(CASE WHEN v < 500 OR egress_qid > 5 THEN 7 ELSE {bin_of('v', LAT_EDGES)} END AS INTEGER) AS lat_bin,
  CAST(CASE WHEN v < 500 OR egress_qid > 5 THEN 0 ELSE {bin_of('v', LAT_EDGES)} END AS INTEGER) AS iat_bin
FROM (SELECT *, (hop_latency_ns >> 10) & 65535 AS v FROM packets)"""
    q["qfi_queue_map"] = """
SELECT packet_id, teid, qfi, CAST(CASE WHEN teid IS NULL THEN 4 WHEN qfi = 1 THEN 0 WHEN qfi = 5 THEN 1 WHEN qfi = 3 THEN 2
  WHEN qfi = 7 THEN 3 WHEN qfi = 4 THEN 4 WHEN qfi = 2 THEN 5 WHEN qfi = 6 THEN 6 ELSE 7 END AS INTEGER) AS queue
FROM (SELECT packet_id, CASE WHEN teid <> 7 THEN teid END AS teid, CAST(qfi + packet_id % 8 AS INTEGER) AS qfi FROM packets)"""
    q["policing_actions"] = """
SELECT packet_id, CAST(c AS INTEGER) AS meter_color, class_queue AS queue,
  CASE c WHEN 0 THEN 'count' WHEN 1 THEN 'requeue' WHEN 2 THEN 'requeue' WHEN 3 THEN 'drop' ELSE 'none' END AS action,
  CASE WHEN c IN (1, 2) THEN 7 ELSE class_queue END AS egress_qid, CASE WHEN c = 3 THEN 1 ELSE 0 END AS dropped
FROM (SELECT *, packet_length % 5 AS c FROM packets)"""
    q["drop_running_count"] = """
SELECT packet_id, flow_idx, CAST(sum(CASE WHEN meter_color = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY flow_idx
  ORDER BY ts_us, packet_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS drop_count
FROM (SELECT *, ((teid << 4) & 65535) | (qfi & 15) AS flow_idx FROM packets)"""
    q["port_totals"] = """
SELECT packet_id % 16 AS dev_port, count(*) AS packets, CAST(sum(packet_length) AS BIGINT) AS bytes
FROM packets GROUP BY 1"""
    q["counter_rates"] = """
SELECT iface, "window", sign(d) * (abs(d) * 800 // 1000000) / 100e0 AS mbps, sign(d) * (abs(d) * 8000 // 1000000000) / 1000e0 AS gbps, pkts
FROM (SELECT qfi AS iface, "window", CAST(sum(packet_length) AS BIGINT)
    - lag(CAST(sum(packet_length) AS BIGINT)) OVER w AS d, count(*) - lag(count(*)) OVER w AS pkts
  FROM packets GROUP BY qfi, "window" WINDOW w AS (PARTITION BY qfi ORDER BY "window"))
WHERE d IS NOT NULL"""
    cell = '"window", qid, "row", bucket'
    q["sketch_traffic"] = f"SELECT {cell}, pkt_cnt, byte_cnt FROM cells"
    q["sketch_colors"] = f"SELECT {cell}, green_cnt, yellow_cnt FROM cells"
    q["sketch_lat_hist"] = f"SELECT {cell}, {', '.join(BINS[:8])} FROM cells"
    q["sketch_iat_hist"] = f"SELECT {cell}, {', '.join(BINS[8:])} FROM cells"
    q["iat_lag"] = 'SELECT packet_id, egress_qid AS qid, "row", bucket, iat FROM fwd'
    q["sketch_lineitem"] = f"""
WITH items AS (SELECT date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS d, l_orderkey AS teid,
    l_linenumber % 9 + 1 AS qfi, l_linenumber % 8 AS qid, CAST(trunc(l_quantity) AS BIGINT) AS bytes FROM lineitem),
  keyed AS MATERIALIZED (SELECT teid, qfi, r, {crc('((r::BIGINT << 40) | (teid << 8) | qfi)')} % 16 AS bucket
    FROM (SELECT DISTINCT teid, qfi FROM items), range(3) t(r))
SELECT CAST(d AS INTEGER) AS "window", qid, r AS "row", bucket, count(*) AS pkt_cnt, CAST(sum(bytes) AS BIGINT) AS byte_cnt
FROM items JOIN keyed USING (teid, qfi) GROUP BY ALL"""
    q["cms_hash"] = f"""
SELECT teid, qfi, CAST(r AS INTEGER) AS "row", key_hex, crc, CAST(crc % 512 AS INTEGER) AS bucket
FROM (SELECT *, lower(lpad(to_hex((teid << 8) | qfi), 10, '0')) AS key_hex,
  {crc('((r::BIGINT << 40) | (teid << 8) | qfi)')} AS crc FROM flows, range(4) t(r))"""
    q["cms_min_query"] = f'SELECT "window", teid, qfi, qid, {", ".join(MEASURES)} FROM recon'
    q["cms_block_query"] = q["cms_min_query"]
    q["cms_stored_query"] = f"""{q['cms_min_query']} WHERE qfi = 2 AND "window" BETWEEN 10 AND 49"""
    q["switch_hash"] = f"""
SELECT teid, qfi, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS crc, CAST(c % 512 AS INTEGER) AS bucket
FROM (SELECT *, {crc16('((r::BIGINT << 38) | (teid << 6) | qfi)')} AS c FROM flows, range(3) t(r))"""
    q["switch_min_query"] = sql(q["cms_min_query"], CTES | {"buckets": SWITCH_BUCKETS})
    q["window_pairing"] = """
SELECT "window", teid, qfi, qid FROM flow_keys WHERE "window" IN
  (SELECT "window" FROM packets WHERE qfi = 1 AND teid = 3 AND meter_color <> 3)"""
    q["first_n_windows"] = f"""
SELECT {cell}, pkt_cnt, byte_cnt FROM cells
WHERE "window" IN (SELECT DISTINCT "window" FROM cells ORDER BY 1 LIMIT 20)"""
    hist_q = {f"p{n}": fx(quant(v, "lat")) for n, v in (("10", "1e-1"), ("50", "5e-1"), ("95", "95e-2"))}
    q["hist_quantile"] = (
        f"SELECT {KEY}, {', '.join(f'{s} AS {n}' for n, s in hist_q.items())} FROM hist_long GROUP BY ALL"
    )
    q["hist_tail_head"] = f"""
SELECT {KEY}, {fx('sum(n / tot) FILTER (WHERE i >= 6)')} AS tail, {fx('sum(n / tot) FILTER (WHERE i < 2)')} AS head
FROM hist_long GROUP BY ALL"""
    for name, shape in (("hist_exceed", ABOVE), ("hist_below", BELOW)):
        parts = (("cold", "0e0"), ("mid", "3e3"), ("top", "4e4"))
        q[name] = (
            f"SELECT {KEY}, {', '.join(f'{hist_fraction(shape, v)} AS {n}' for n, v in parts)} "
            "FROM hist_long GROUP BY ALL"
        )
    q["active_teids"] = f"""
SELECT {KEY}, CAST(sum(green_cnt + yellow_cnt + drop_cnt) AS BIGINT) AS class_pkts,
  count(*) FILTER (WHERE green_cnt + yellow_cnt + drop_cnt > 0) AS active_teids FROM exact GROUP BY ALL"""
    q["teid_traffic_rates"] = (
        f"SELECT {TKEY}, {fixed_columns(['feat_bw_mbps', 'feat_pps'], 12)} FROM exact_features"
    )
    q["teid_share"] = (
        f"SELECT {TKEY}, {fixed_columns(['feat_teid_share', 'feat_yellow_frac', 'feat_red_frac'])} "
        "FROM exact_features"
    )
    q["rolling_threshold"] = f"""
SELECT {TKEY}, {fx('coalesce(quantile_cont(a, 0.95) OVER w, 0)')} AS thr_lat_ms,
  {fx('coalesce(quantile_cont(b, 0.1) OVER w, 0)')} AS thr_iat_us
FROM (SELECT {TKEY}, max(hop_latency_ns) / 1e6 AS a, CAST(min(packet_length) AS DOUBLE) AS b FROM packets GROUP BY ALL)
WINDOW w AS (PARTITION BY qfi, teid ORDER BY "window" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""
    q["teid_features"] = (
        f"SELECT {TKEY}, {fixed_columns(FEATURES[:-1])}, feat_qfi_teid_count FROM features"
    )
    q["qfi_rollup"] = (
        f"SELECT {KEY}, {fixed_columns(LIGHT + ['qfi_bw_total'])} FROM light_classes"
    )
    q["qfi_valid"] = f"SELECT {KEY}, {fixed_columns(['feat_bw_mbps', 'qfi_bw_total'])} FROM odd_classes WHERE qfi >= 0"
    q["qfi_concentration"] = f"""SELECT {KEY}, {fixed_columns(
        ['qfi_teid_hhi', 'qfi_teid_top1_share', 'qfi_teid_top2_share', 'qfi_frac_teids_active'])} FROM light_classes"""
    q["qfi_entropy"] = f"SELECT {KEY}, {fixed_columns(['qfi_share_entropy'])} FROM light_classes"
    q["qfi_color_bw_share"] = (
        f"SELECT {KEY}, {fixed_columns(['qfi_yellow_bw_share', 'qfi_red_bw_share'])} FROM light_classes"
    )
    q["qfi_aggregate"] = f"SELECT {KEY}, {fixed_columns(BASE)} FROM classes"

    def rolled(names: list[str]) -> str:
        cols = ", ".join(f"{ROLL_OUT[n]} AS {n}" for n in names)
        return f"SELECT {KEY}, {fixed_columns(names, 6)} FROM (SELECT {KEY}, {cols} FROM series)"

    q["rolling_stats"] = rolled(["roll3_med", "roll5_med", "roll9_med", "roll5_max", "roll5_std"])
    q["delta_lag"] = rolled(["delta"])
    q["ewma"] = rolled(["ewma"])
    q["slope5"] = rolled(["slope5"])
    q["robust_z"] = f"SELECT {KEY}, {fx('rz', 6)} AS rz FROM (SELECT {KEY}, {z('x', 21)} AS rz FROM series)"
    q["z_short_long"] = f"""
SELECT {KEY}, {fixed_columns(['zs', 'zl'], 6)}, {fx('zs - zl', 6)} AS delta_sl
FROM (SELECT {KEY}, {z('x', 7)} AS zs, {z('x', 21)} AS zl FROM series)"""
    q["run_length"] = f"""
SELECT {KEY}, CAST({run_of('zl')} AS INTEGER) AS runlen FROM (SELECT {KEY}, rn, {z('x', 21)} AS zl FROM series)"""
    quoted = ", ".join(f'{fx(chr(34) + c + chr(34), 7)} AS "{c}"' for c in ENGINEERED)
    q["qfi_engineered_features"] = f"SELECT {KEY}, {quoted} FROM engineered"
    q["tree_score"] = f"""
SELECT {KEY}, {fx('1e0 / (1e0 + exp(-m))')} AS score FROM (
  SELECT {KEY}, 25e-2 + {stump("count(*) FILTER (WHERE meter_color = 1) / CAST(count(*) AS DOUBLE)", '3e-1', '-15e-1', '125e-2')}
    + {stump('sum(packet_length)', '1e4', '-75e-2', '5e-1')} + 125e-3 AS m FROM packets GROUP BY ALL)"""
    forest = large_model()
    # Trees are added one after another; the margin of each row is a sum of a list.
    margins = ", ".join(tree_case(t, ["yellow", "bytes"]) for t in forest["trees"])
    q["tree_score_large"] = f"""
SELECT {KEY}, {fx('1e0 / (1e0 + exp(-m))')} AS score FROM (
  SELECT {KEY}, list_reduce([{forest['base_margin']!r}e0, {margins}], lambda a, b: a + b) AS m FROM (
    SELECT {KEY}, count(*) FILTER (WHERE meter_color = 1) / CAST(count(*) AS DOUBLE) AS yellow, CAST(sum(packet_length) AS DOUBLE) AS bytes
    FROM packets GROUP BY ALL))"""
    events = f"{KEY}, {fixed_columns(['score', 'thr'])}, pred"
    q["threshold_join"] = f"SELECT {events} FROM scored"
    q["debounce"] = f"SELECT {events}, debounced FROM event_rows"
    q["events_sink"] = q["debounce"]
    # k = 1, h = 1.3, as a walk over each class's rows: set when pred, then reset when low.
    q["debounce_inverting"] = f"""
WITH RECURSIVE walk AS (
  SELECT s.*, s.pred AS debounced FROM ranked s WHERE rn = 1
  UNION ALL
  SELECT s.*, CASE WHEN w.debounced = 0 THEN s.pred WHEN s.score < s.thr * 13e-1 THEN 0 ELSE 1 END
  FROM walk w JOIN ranked s ON s.qfi = w.qfi AND s.rn = w.rn + 1)
SELECT {events}, debounced FROM walk"""
    eps = f"qfi, start_win, end_win, {fx('peak_score')} AS peak_score, duration"
    q["episodes"] = f"SELECT {eps} FROM episode_rows"
    q["episode_transitions"] = f"""
SELECT {KEY}, CASE WHEN debounced = 1 THEN 'start' ELSE 'end' END AS transition
FROM (SELECT *, coalesce(lag(debounced) OVER (PARTITION BY qfi ORDER BY "window"), 0) AS b FROM event_rows)
WHERE debounced <> b"""
    q["run_summary"] = """
SELECT count(DISTINCT "window") AS windows_processed, count(DISTINCT qfi) AS qfis_monitored,
  (SELECT count(*) FROM episode_rows) AS episodes FROM event_rows"""
    q["event_quality"] = """
SELECT count(*) AS events, 0::BIGINT AS null_fields,
  count(*) FILTER (WHERE score NOT BETWEEN 0 AND 1) AS score_out_of_range,
  count(*) FILTER (WHERE thr NOT BETWEEN 0 AND 1) AS thr_out_of_range,
  count(*) FILTER (WHERE pred NOT IN (0, 1)) AS bad_pred,
  count(*) FILTER (WHERE debounced NOT IN (0, 1)) AS bad_debounced FROM event_rows"""
    q["score_separation"] = f"""
SELECT {fixed_columns(['mean_positive', 'mean_negative'])}, {fx('mean_positive - mean_negative')} AS separation
FROM (SELECT avg(score) FILTER (WHERE pred = 1) AS mean_positive, avg(score) FILTER (WHERE pred = 0) AS mean_negative
  FROM event_rows)"""
    q["threshold_consistency"] = """
SELECT qfi, count(DISTINCT round(thr, 6)) AS thresholds,
  (SELECT count(DISTINCT round(thr, 6)) FROM scored) AS overall FROM scored GROUP BY qfi"""
    q["episode_mix"] = f"""
SELECT CASE WHEN duration <= 3 THEN 'short' WHEN duration >= 5 THEN 'sustained' ELSE 'middle' END AS kind,
  count(*) AS episodes, count(DISTINCT qfi) AS classes, {fx('max(peak_score)')} AS peak_score, max(duration) AS longest
FROM episode_rows GROUP BY 1"""
    q["debounce_effect"] = """
SELECT count(*) FILTER (WHERE pred = 1) AS positive, count(*) FILTER (WHERE debounced = 1) AS debounced
FROM event_rows"""
    q["detect_events"] = f"SELECT {events}, debounced FROM full_event_rows"
    q["detect_episodes"] = f"SELECT {eps} FROM full_episode_rows ORDER BY start_win, qfi"
    q["parse_int_list"] = "SELECT event_id, user_id || '|' || event_id AS parsed FROM events"
    q["parse_qfi_map"] = """
SELECT event_id, CAST(CASE WHEN v = 3 THEN f ELSE 6 END AS INTEGER) AS fake_of_3, CAST(f AS INTEGER) AS fake_of_victim
FROM (SELECT event_id, user_id % 9 + 1 AS v, event_id % 9 + 1 AS f FROM events)"""
    q["teid_text"] = """
SELECT event_id, '0x' || lower(to_hex(user_id * 7654321 + event_id)) AS text, user_id * 7654321 + event_id AS teid
FROM events"""
    q["tumbling_1s"] = """
SELECT ts_us // 1000000 AS second, qfi, count(*) AS pkt_cnt, CAST(sum(packet_length) AS BIGINT) AS byte_cnt
FROM packets GROUP BY ALL"""
    q["postcard_stats_1s"] = """
SELECT host_timestamp_ns // 1000000000 AS second, count(*) AS total, count(*) FILTER (WHERE queue_depth > 0) AS queued
FROM cards GROUP BY ALL"""
    q["stream_stats_1s"] = q["postcard_stats_1s"]
    q["stream_alarms"] = q["debounce"]
    def device(d: int) -> str:
        own = CTES | {"packets": f"{CTES['packets']} WHERE event_id % 2 = {d}"}
        return f"""SELECT '{d}' AS run, * FROM ({sql(q['detect_events'] + ' WHERE "window" IN (SELECT "window" FROM sketch)', own)})"""

    q["detect_runs"] = f"WITH devices AS ({device(0)} UNION ALL {device(1)}) SELECT * FROM devices"
    # Snapshots exist for windows with a cell.
    q["detect_files"] = f"""{q['detect_events']}
WHERE "window" IN (SELECT "window" FROM sketch)"""
    q["stream_detect"] = q["detect_files"]
    q["stream_episodes"] = q["episodes"]
    q["stream_thresholds"] = q["rolling_threshold"]
    q["postcard_record_files"] = f"SELECT {big(WIRE + ['host_timestamp_ns'])} FROM cards"

    recursive = q.pop("debounce_inverting").replace("WITH RECURSIVE", "").strip()
    ranked = f'SELECT *, row_number() OVER (PARTITION BY qfi ORDER BY "window") AS rn FROM scored'
    base = f"packets AS MATERIALIZED ({CTES['packets']}), scored AS MATERIALIZED ({CTES['scored']}), ranked AS MATERIALIZED ({ranked})"
    out = {name: text if text.lstrip().startswith("WITH") else sql(text) for name, text in q.items()}
    out["debounce_inverting"] = f"WITH RECURSIVE {base}, {recursive}"
    return out
