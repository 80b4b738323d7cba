"""Peaks by prominence, and spectra, of a per-track signal.

A signal of any length is cut into chunks. A chunk decides every peak whose two
bases lie inside it and, for the rest, hands on an outline: its record heights seen
from either edge with the lowest value behind each. The outlines of one signal are
small, and a second grouped step finishes the open peaks with them. The result
equals a search over the whole signal.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import written
from .grouped import key_types, map_groups
from .ranking import join_groups

CHUNK = 65536


def _lows(e: np.ndarray, head: np.ndarray):
    """Lowest value back to the nearest strictly higher one of the signal, and whether there is one; `head` marks first values."""
    values, low, bounded, stack = e.tolist(), [], [], []
    for j, (v, new) in enumerate(zip(values, head.tolist())):
        least = v
        if new:
            stack.clear()
        while stack and values[stack[-1]] <= v:
            least = min(least, low[stack.pop()])
        low.append(least)
        bounded.append(bool(stack))
        stack.append(j)
    return np.array(low, float), np.array(bounded, bool)


def _records(e: np.ndarray):
    """Record heights seen from the left, each with the lowest value up to the next."""
    top = np.maximum.accumulate(e)
    at = np.flatnonzero(np.r_[True, top[1:] > top[:-1]])
    return e[at], np.minimum.reduceat(e, at)


def _tops(v: np.ndarray, starts: np.ndarray, prominence: float):
    """Runs of equal values of signals that lie one behind the other, and what is known of each maximum.

    (first and last position of a run, values of all turning and end runs, the maxima's runs, lowest values
    to both sides, whether those suffice, whether a higher value bounds each side).
    """
    new = np.zeros(len(v), bool)
    new[starts] = True
    cut = new.copy()
    cut[1:] |= np.diff(v) != 0
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], len(v)] - 1
    rv, head = v[first], new[first]
    tail = np.r_[head[1:], True]
    before, after = np.r_[rv[:1], rv[:-1]], np.r_[rv[1:], rv[-1:]]
    inner = ~head & ~tail
    up = inner & (rv > before) & (rv > after)
    turning = up | ~inner | (inner & (rv < before) & (rv < after))
    at = np.flatnonzero(turning)
    e, mark = rv[at], up[at]
    left, left_ok = _lows(e, head[at])
    right, right_ok = (x[::-1] for x in _lows(e[::-1], tail[at][::-1]))
    up, left, right = at[mark], left[mark], right[mark]
    return first, last, e, up, left, right, rv[up] - left >= prominence, rv[up] - right >= prominence, left_ok[mark], right_ok[mark]


def _whole_signals(order, frame, value, chunk, starts, prominence):
    """Rows of _COLS for the peaks of whole signals, and the position each lies at."""
    parts, owner = [], []
    for sign in (1, -1):
        first, last, _, up, left, right, lo_pass, hi_pass, _, _ = _tops(sign * value, starts, prominence)
        good = lo_pass & hi_pass                 # an open side ends at the end of the signal
        up, left, right = up[good], left[good], right[good]
        mid = (first[up] + last[up]) // 2
        parts.append(pd.DataFrame({
            "grp": 1 + chunk[mid], "kind": "peak", "sign": sign, "chunk": chunk[mid], "lo": order[mid], "hi": order[mid], "value": sign * value[mid],
            "lmin": left, "rmin": right, "lok": True, "rok": True, "at": frame[mid], "frames": None}))
        owner.append(mid)
    return pd.concat(parts, ignore_index=True), np.concatenate(owner)


def _scan_chunk(order, frame, value, prominence, sign, chunk, out):
    """Rows of _COLS of one chunk of a longer signal: its peaks, what is open, and its outline."""
    v = sign * value
    first, last, e, up, left, right, lo_pass, hi_pass, left_ok, right_ok = _tops(v, np.array([0]), prominence)
    rv, m = v[first], len(first)
    for j in np.flatnonzero((lo_pass | ~left_ok) & (hi_pass | ~right_ok)):
        done = bool(lo_pass[j] and hi_pass[j])
        mid = (first[up[j]] + last[up[j]]) // 2
        out.append((1 + chunk if done else 0, "peak" if done else "open", sign, chunk, int(order[mid]), int(order[mid]), float(rv[up[j]]),
                    float(left[j]), float(right[j]), bool(lo_pass[j]), bool(hi_pass[j]), int(frame[mid]), None))
    edge = np.unique(np.clip([0, 1, m - 2, m - 1], 0, m - 1))
    for side, seq in (("right", e), ("left", e[::-1])):
        for i, (top, low) in enumerate(zip(*_records(seq))):
            out.append((0, side, sign, chunk, i, i, float(top), float(low), 0.0, False, False, None, None))
    for r in edge:
        outer = r in (0, m - 1)
        frames = frame[first[r]:last[r] + 1].tolist() if outer else None
        out.append((0, "edge", sign, chunk, int(order[first[r]]), int(order[last[r]]), float(rv[r]),
                    0.0, 0.0, bool(r == 0), bool(r == m - 1), int(frame[(first[r] + last[r]) // 2]), frames))


_COLS = ["grp", "kind", "sign", "chunk", "lo", "hi", "value", "lmin", "rmin", "lok", "rok", "at", "frames"]
_TYPES = ("grp bigint, kind string, sign int, chunk bigint, lo bigint, hi bigint, value double, "
          "lmin double, rmin double, lok boolean, rok boolean, at bigint, frames array<bigint>")


def _finish(rows: pd.DataFrame, prominence: float):
    """Accepted (ord, frame, height) of one signal and one sign."""
    sides = {}
    for side in ("left", "right"):
        r = rows[rows["kind"] == side].sort_values(["chunk", "lo"])
        sides[side] = {c: list(zip(g["value"], g["lmin"])) for c, g in r.groupby("chunk")}

    def reaches(side, chunk, step, v, low):
        outline = sides[side]
        while v - low < prominence and chunk in outline:
            for top, behind in outline[chunk]:
                if top > v:
                    return v - low >= prominence
                low = min(low, behind)
            chunk += step
        return v - low >= prominence

    for r in rows[rows["kind"] == "open"].itertuples():
        if ((r.lok or reaches("left", r.chunk - 1, -1, r.value, r.lmin))
                and (r.rok or reaches("right", r.chunk + 1, 1, r.value, r.rmin))):
            yield r.lo, int(r.at), r.value
    runs = []
    for r in rows[rows["kind"] == "edge"].sort_values("lo").itertuples():
        outer = r.lok or r.rok
        lstart = r.chunk - 1 if r.lok else r.chunk
        rstart = r.chunk + 1 if r.rok else r.chunk
        frames = list(r.frames) if outer else []
        if runs and runs[-1]["v"] == r.value and runs[-1]["hi"] + 1 == r.lo:
            runs[-1].update(hi=r.hi, rstart=rstart, frames=runs[-1]["frames"] + frames)
        else:
            runs.append(dict(lo=r.lo, hi=r.hi, v=r.value, outer=outer, lstart=lstart, rstart=rstart, frames=frames))
    for a, b, c in zip(runs, runs[1:], runs[2:]):
        touching = a["hi"] + 1 == b["lo"] and b["hi"] + 1 == c["lo"]
        if (b["outer"] and touching and b["v"] > a["v"] and b["v"] > c["v"]
                and reaches("left", b["lstart"], -1, b["v"], b["v"])
                and reaches("right", b["rstart"], 1, b["v"], b["v"])):
            mid = (b["lo"] + b["hi"]) // 2
            yield mid, b["frames"][mid - b["lo"]], b["v"]


def find_peaks(samples: DataFrame, keys: Sequence[str], value: str, prominence: float,
               chunk: int = CHUNK) -> DataFrame:
    """Peaks of both signs: (keys, sign, ord, frame, height).

    `samples` carries `ord` (1-based position among valid samples of the signal),
    `frame` and `n_valid` (signal length). Plateaus count once, at their middle; end
    points are never peaks.
    """
    keys = list(keys)
    d = samples.select(*keys, "ord", "frame", "n_valid", F.col(value).cast("double").alias("value"),
                       F.floor(F.col("ord") / F.lit(chunk)).cast("long").alias("chunk"))

    def first_pass(rows, starts):
        order, frame, val = (rows[c].to_numpy() for c in ("ord", "frame", "value"))
        chunks, total = rows["chunk"].to_numpy(), rows["n_valid"].to_numpy()
        size = np.diff(np.r_[starts, len(rows)])
        whole = size == total[starts]
        own = np.repeat(whole, size)
        at = np.flatnonzero(own)
        begins = np.cumsum(size[whole]) - size[whole]
        found, owner = _whole_signals(order[at], frame[at], val[at], chunks[at], begins, prominence) if len(at) else (None, at)
        parts = [] if found is None else [pd.concat([rows[keys].iloc[at[owner]].reset_index(drop=True), found], axis=1)]
        out, owner = [], []
        for a, n in zip(starts[~whole], size[~whole]):
            for sign in (1, -1):
                _scan_chunk(order[a:a + n], frame[a:a + n], val[a:a + n], prominence, sign, int(chunks[a]), out)
            owner.extend([a] * (len(out) - len(owner)))
        if out:
            found = pd.DataFrame(out, columns=_COLS).astype({"at": "Int64"})
            parts.append(pd.concat([rows[keys].iloc[owner].reset_index(drop=True), found], axis=1))
        return pd.concat(parts, ignore_index=True)

    def second_pass(rows, starts):
        done = rows[rows["grp"] > 0]
        parts = [done[keys].assign(sign=done["sign"], ord=done["lo"], frame=done["at"],
                                   height=done["sign"] * done["value"])]
        grp = rows["grp"].to_numpy()
        for a, b in zip(starts, np.r_[starts[1:], len(rows)]):
            if grp[a] > 0:
                continue
            part = rows.iloc[a:b]
            out = [(s, o, f, s * v) for s, g in part.groupby("sign") for o, f, v in _finish(g, prominence)]
            if out:
                found = pd.DataFrame(out, columns=["sign", "ord", "frame", "height"])
                parts.append(pd.concat([part[keys].iloc[[0] * len(out)].reset_index(drop=True), found], axis=1))
        return pd.concat(parts, ignore_index=True)

    types = key_types(d, keys)
    outline = map_groups(d, [*keys, "chunk"], ["ord"], first_pass, f"{types}, {_TYPES}")
    return map_groups(outline, [*keys, "grp"], [], second_pass, f"{types}, sign int, ord bigint, frame bigint, height double")


def spectrum(samples: DataFrame, keys: Sequence[str], value: str, fps: float,
             small: int = 1_000_000) -> DataFrame:
    """Amplitude 2/n |rfft(x - mean)| per frequency: (keys, k, freq, amplitude).

    Signals up to `small` samples take one FFT per Arrow group; longer ones are summed
    per frequency with a distributed aggregate, so no signal must fit one task.
    """
    keys = list(keys)
    d = written(samples.select(*keys, "ord", F.col(value).cast("double").alias("value")), "samples")
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("_mean"))
    d = join_groups(d, n, keys)
    types = key_types(d, keys)

    def fft(rows, starts):
        x, parts, owner = rows["value"].to_numpy(), [], []
        for a, b in zip(starts, np.r_[starts[1:], len(rows)]):
            v = x[a:b]
            amp = np.abs(np.fft.rfft(v - v.mean())) * (2.0 / len(v))
            k = np.arange(len(amp))
            parts.append(pd.DataFrame({"k": k, "freq": k * fps / len(v), "amplitude": amp}))
            owner.extend([a] * len(amp))
        return pd.concat([rows[keys].iloc[owner].reset_index(drop=True), pd.concat(parts, ignore_index=True)], axis=1)

    short = map_groups(d.where(F.col("n") <= small).drop("n", "_mean"), keys, ["ord"], fft, f"{types}, k bigint, freq double, amplitude double")
    turn = F.lit(-2 * np.pi) * F.pmod(F.col("k") * (F.col("ord") - 1), F.col("n")) / F.col("n")
    long = (d.where(F.col("n") > small)
            .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 2))))
            .groupBy(*keys, "n", "k").agg(
                F.sum((F.col("value") - F.col("_mean")) * F.cos(turn)).alias("_re"),
                F.sum((F.col("value") - F.col("_mean")) * F.sin(turn)).alias("_im"))
            .select(*keys, "k", (F.col("k") * F.lit(fps) / F.col("n")).alias("freq"),
                    (F.sqrt(F.col("_re") ** 2 + F.col("_im") ** 2) * 2 / F.col("n")).alias("amplitude")))
    return short.unionByName(long)


def band_power(spec: DataFrame, keys: Sequence[str], lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    """Sum of squared amplitudes inside the bend band and its share of the total."""
    inside = F.col("freq").between(lo, hi)
    p = F.col("amplitude") ** 2
    return spec.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(inside, p)), F.lit(0.0)).alias("band_power"),
        F.try_divide(F.coalesce(F.sum(F.when(inside, p)), F.lit(0.0)), F.sum(p)).alias("band_share"))
