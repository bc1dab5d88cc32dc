"""States handed from block to block of a series.

A block gives, for each state, a small map of what comes in to what goes out: a fixed value, the same, a sum added, a clamp, or (for the
filter that follows by at most a step) a rising line of slopes 0 and 1, given by its corners. The maps of a series' blocks, a row for each
block, are applied one behind the other.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Map = list


def fixed(value: float) -> Map:
    return ["fixed", value]


def same() -> Map:
    return ["same"]


def plus(value: float) -> Map:
    return ["plus", value]


def clamp(low: float, high: float) -> Map:
    return ["clamp", low, high]


def follow(x: np.ndarray, step: np.ndarray, least: float, most: float) -> Map:
    """The map of y moving towards each x by at most its step, for y within least and most: corners (what comes in, what goes out)."""
    u, v = np.array([least, most]), np.array([least, most])
    for value, width in zip(x[step > 0].tolist(), step[step > 0].tolist(), strict=True):  # without a step nothing moves
        if v[0] == v[-1]:
            u = u[[0, -1]]
            v = v[[0, -1]]
        elif len(v):
            edges = [e for e in (value - width, value + width) if v[0] < e < v[-1]]
            if edges:  # a new corner where the line crosses an edge
                more = np.interp(edges, v, u) if np.all(np.diff(v) > 0) else np.array([_at(u, v, e) for e in edges])
                at = np.searchsorted(u, more)
                u, v = np.insert(u, at, more), np.insert(v, at, edges)
        v = v + np.clip(value - v, -width, width)
        if len(u) > 2:
            slope = np.diff(v) > 0.5 * np.diff(u)
            keep = np.concatenate(([True], slope[1:] != slope[:-1], [True]))
            u, v = u[keep], v[keep]
    return ["line", u.tolist(), v.tolist()]


def _at(u: np.ndarray, v: np.ndarray, value: float) -> float:
    """Where a rising line with flat parts has a value between its ends."""
    i = int(np.searchsorted(v, value, "left"))  # v[i - 1] < value <= v[i]
    return float(u[i] - (v[i] - value)) if v[i] > value else float(u[i])


def unknown() -> Map:
    return ["unknown"]


def through(way: Map, value: float | None, all_within: bool) -> float | None:
    """What goes out; None if that depends on what came in and this isn't known. all_within: whether whatever comes in lies between a line's ends."""
    kind, *of = way
    if kind == "fixed":
        return of[0]
    if kind == "clamp" and of[0] == of[1]:
        return of[0]
    if kind == "line":
        (u, v) = of
        if v[0] == v[-1] and (all_within or value is not None and u[0] <= value <= u[-1]):
            return v[0]
        return float(np.interp(value, u, v)) if value is not None and u[0] <= value <= u[-1] else None
    if value is None or kind == "unknown":
        return None
    return value if kind == "same" else value + of[0] if kind == "plus" else min(max(value, of[0]), of[1])


def unsettled(ends: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """Of rows (symbol, block, ends: JSON): the blocks that haven't settled, with the states that are handed to them (0 for those that aren't known).

    A series' blocks, some of thousands of rows each, are read in one go; that is a row or two for each.
    """
    schema = "symbol string, block long, " + ", ".join(f"given_{k} double" for k in states)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        blocks: dict[int, dict] = {}
        for k, text in zip(rows["block"].tolist(), rows["ends"].tolist(), strict=True):
            blocks.setdefault(k, {}).update(json.loads(text))
        out: list[tuple] = []
        state: dict[str, float | None] = {}
        start, low, high = None, np.inf, -np.inf
        for k in sorted(blocks):
            b = blocks[k]
            # runs from below and above are those of the true level if it lay between them at the block's first row
            between = b["least"] <= start <= b["most"] if start is not None else b["least"] <= low and high <= b["most"]
            sound = b["begins"] or b["wide"] or b["exact"] or not b["worm"] or between
            late = b.get("trend_in") is not None and b["trend_in"] != (state.get("trend") or 0.0)
            good = b["begins"] or b["exact"] or b["ok"] and sound
            if not good or late:
                out.append((rows["symbol"].iloc[0], k, *[state.get(s) or 0.0 for s in states]))
            state = {s: None if s == "worm" and not sound and w[0] == "fixed" else through(w, state.get(s), sound) for s, w in b.get("states", {}).items()}
            start, low, high = b.get("next") if good else None, min(low, b["low"]), max(high, b["high"])
        return pd.DataFrame(out, columns=["symbol", "block", *[f"given_{s}" for s in states]])

    return ends.groupBy("symbol").applyInPandas(fold, schema)
