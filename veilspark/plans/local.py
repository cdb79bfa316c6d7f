"""Finishing one bounded partition inside a task.

Shipped to the executors by value, so they need no installation of this package.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _first_seen(codes: np.ndarray) -> list | np.ndarray:
    """Distinct values in order of appearance; a dict is faster on a short array."""
    return list(dict.fromkeys(codes.tolist())) if codes.size < 200 else pd.unique(codes)


def _among(codes: np.ndarray, chosen) -> np.ndarray:
    if codes.size < 200:
        chosen = set(chosen)
        return np.fromiter((c in chosen for c in codes.tolist()), bool, codes.size)
    return np.isin(codes, chosen)


def finish_partition(group: pd.DataFrame, rules, names: list[str], stop_at: int = 0) -> pd.DataFrame:
    """All remaining splits of one bounded partition, on its cells in row order.

    Parts of at most ``stop_at`` cells are left for another task to finish.
    """
    group = group.sort_values("_o", kind="stable", ignore_index=True)
    rows = group["_n"].to_numpy()
    sensitive = pd.factorize(group["_s"], use_na_sentinel=False)[0]
    columns = [
        pd.factorize(group[c], use_na_sentinel=False)[0]
        if i in rules.categorical
        else group[c].to_numpy(dtype=float, na_value=np.nan)
        for i, c in enumerate(names)
    ]
    gaps = [i not in rules.categorical and np.isnan(c).any() for i, c in enumerate(columns)]
    if rules.model == "t":
        q, rank, next_q = (
            group[c].to_numpy(dtype=float, na_value=np.nan) for c in ("q", "rank", "next_q")
        )

    def span(i: int, part: np.ndarray) -> float:
        if not rules.scale[i]:
            return 0.0
        if i in rules.categorical:
            return len(_first_seen(columns[i][part])) / rules.scale[i]
        held = columns[i][part]
        held = held[~np.isnan(held)] if gaps[i] else held
        return float(held.max() - held.min()) / rules.scale[i] if held.size else 0.0

    def left_half(i: int, part: np.ndarray) -> np.ndarray:
        held = columns[i][part]
        if i in rules.categorical:
            seen = _first_seen(held)
            return _among(held, seen[: len(seen) // 2])
        numbers, weights = held, rows[part]
        if gaps[i]:
            known = ~np.isnan(held)
            if not known.any():
                return known
            numbers, weights = held[known], weights[known]
        by_value = np.argsort(numbers, kind="stable")
        running = np.cumsum(weights[by_value])
        return held < numbers[by_value[np.searchsorted(running, running[-1] // 2, side="right")]]

    def distance(part: np.ndarray) -> float:
        known = part[~np.isnan(rank[part])]
        if not known.size:
            return rules.top_q if rules.values == "all" else 0.0
        by_rank = known[np.argsort(rank[known], kind="stable")]
        first = np.flatnonzero(np.append(True, np.diff(rank[by_rank]) != 0))
        at = by_rank[first]
        share = np.add.reduceat(rows[by_rank], first) / rows[part].sum()
        found = np.abs(share - q[at]).max()
        if rules.values == "present":
            return found
        gap = next_q[at][np.append(np.diff(rank[at]) != 1, True)].max()
        return max(found, gap, rules.top_q if rank[at[0]] != 0 else 0.0)

    def valid(part: np.ndarray) -> bool:
        if rows[part].sum() < rules.k:
            return False
        if rules.model == "l":
            return len(_first_seen(sensitive[part])) >= rules.l
        return rules.model != "t" or distance(part) <= rules.p

    paths = np.empty(len(group), dtype=object)
    open_parts = [(np.arange(len(group)), group["_pid"].iat[0])]
    while open_parts:
        part, path = open_parts.pop()
        paths[part] = path
        if part.size <= stop_at or rows[part].sum() < 2 * rules.k:
            continue
        for i in sorted(range(rules.features), key=lambda i: -span(i, part)):
            mask = left_half(i, part)
            left, right = part[mask], part[~mask]
            if left.size and right.size and valid(left) and valid(right):
                open_parts += [(left, path + "0"), (right, path + "1")]
                break
    return group.assign(_pid=paths)
