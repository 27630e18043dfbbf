"""Functions over histogram arrays: counts per bin, upper edges of all bins but the open last one.

They take and give SQL expression text, so that a nested formula reaches Spark in one parse. The arrays
hold as many elements as a register has bins.
"""

from __future__ import annotations


def bin_index(value: str, edges: str, n_edges: int) -> str:
    """Bin of ``value``: the number of edges that are not above it.

    The number of edges is known from the sketch geometry, so this unrolls into plain
    comparisons that stay inside generated code.
    """
    hits = [f"IF({value} >= get({edges}, {i}), 1, 0)" for i in range(n_edges)]
    return " + ".join(hits) if hits else "0"


def usable_edges(edges: str, counts: str) -> str:
    """Edges of a queue, empty if the queue has none, cut to one fewer than the bins."""
    known = f"coalesce({edges}, CAST(array() AS ARRAY<DOUBLE>))"
    return f"slice({known}, 1, greatest(size({counts}) - 1, 0))"


def total(counts: str) -> str:
    return f"aggregate({counts}, 0D, (acc, n) -> acc + n)"


def bins(counts: str, edges: str) -> str:
    """One struct per bin: count ``n``, limits ``lo`` and ``hi``; ``hi`` is null for the open bin.

    The array is empty if there are no edges, which makes every function below answer 0.
    """
    cell = (
        f"named_struct('n', CAST(n AS DOUBLE), 'lo', coalesce(get({edges}, i - 1), 0D), "
        f"'hi', get({edges}, i))"
    )
    return f"filter(transform({counts}, (n, i) -> {cell}), b -> size({edges}) > 0)"


def quantile_of(binned: str, q: float) -> str:
    """Linear interpolation inside the bin where the cumulative count first reaches the target.

    The open last bin answers with the last edge; an empty histogram with 0.
    """
    share = min(max(q, 0.0), 1.0)
    target = f"aggregate({binned}, 0D, (t, b) -> t + b.n) * {share!r}D"
    missing = "(acc.target - acc.seen)"
    within = f"least(greatest({missing} / b.n, 0D), 1D)"
    inside = f"IF(b.n > 0 AND b.hi > b.lo, b.lo + {within} * (b.hi - b.lo), b.lo)"
    return f"""coalesce(aggregate({binned},
        named_struct('seen', 0D, 'target', {target}, 'value', CAST(NULL AS DOUBLE)),
        (acc, b) -> named_struct('seen', acc.seen + b.n, 'target', acc.target,
            'value', coalesce(acc.value, IF(b.n >= {missing}, {inside}, NULL))),
        acc -> IF(acc.seen > 0, acc.value, NULL)), 0D)"""


def _share_of(binned: str, weight: str, threshold: str) -> str:
    """Weighted share of the packets: ``weight`` says how much of a bin ``b`` counts."""
    share = f"""aggregate({binned}, named_struct('hit', 0D, 'all', 0D),
        (acc, b) -> named_struct('hit', acc.hit + b.n * {weight}, 'all', acc.all + b.n),
        acc -> IF(acc.all > 0, acc.hit / acc.all, 0D))"""
    return f"IF(abs({threshold}) < DOUBLE('Infinity'), {share}, 0D)"


def exceed_of(binned: str, threshold: str) -> str:
    """Share above the threshold; the open bin counts only if it starts at or above it."""
    t = threshold
    weight = f"CASE WHEN b.lo >= {t} THEN 1D WHEN b.hi > {t} THEN (b.hi - {t}) / (b.hi - b.lo) ELSE 0D END"
    return _share_of(binned, weight, t)


def below_of(binned: str, threshold: str) -> str:
    """Share below the threshold; the open bin never counts."""
    t = threshold
    part = f"WHEN b.lo < {t} AND {t} < b.hi THEN ({t} - b.lo) / (b.hi - b.lo)"
    return _share_of(binned, f"CASE WHEN b.hi <= {t} THEN 1D {part} ELSE 0D END", t)


def quantile(counts: str, edges: str, q: float) -> str:
    return quantile_of(bins(counts, edges), q)


def exceed_fraction(counts: str, edges: str, threshold: str) -> str:
    return exceed_of(bins(counts, edges), threshold)


def below_fraction(counts: str, edges: str, threshold: str) -> str:
    return below_of(bins(counts, edges), threshold)


def _part(part: str, counts: str) -> str:
    return f"IF({total(counts)} > 0, {total(part)} / {total(counts)}, 0D)"


def tail_fraction(counts: str, n_bins: int) -> str:
    """Share of packets in the last ``n_bins`` bins."""
    n = f"greatest(least({n_bins}, size({counts})), 1)"
    return _part(f"slice({counts}, size({counts}) - {n} + 1, {n})", counts)


def head_fraction(counts: str, n_bins: int) -> str:
    """Share of packets in the first ``n_bins`` bins."""
    return _part(f"slice({counts}, 1, {max(n_bins, 1)})", counts)
