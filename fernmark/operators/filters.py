"""Butterworth filters as second-order sections whose state goes from chunk to chunk.

A filter of order n is a product of sections of order two; each keeps two numbers
between samples. ``streamed`` keeps them as a stream's state, so a recording
that comes in chunks is filtered like the whole, and ``filtered`` filters arrays in rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def butterworth(order: int, rate: float, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Sections (b0, b1, b2, a1, a2), the first with the gain: a low pass (only ``high``), a high pass (only ``low``) or a band pass.

    Poles of the analog filter lie on a circle; they are moved to the band (a band pass
    has twice as many) and to the unit disk by the bilinear transform.
    """
    if low is None and high is None:
        raise ValueError("a filter needs an edge")
    edges = [2 * rate * np.tan(np.pi * f / rate) for f in (low, high) if f is not None]  # warped
    if any(not 0 < f < rate / 2 for f in (low, high) if f is not None) or (low is not None and high is not None and low >= high):
        raise ValueError("edges lie between 0 and half the rate, the lower one first")
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if low is not None and high is not None:
        wide, centre = edges[1] - edges[0], edges[0] * edges[1]
        half = poles * wide / 2
        poles = np.concatenate([half + np.sqrt(half**2 - centre), half - np.sqrt(half**2 - centre)])
        zeros, middle = [1.0, -1.0], 2 * np.arctan(np.sqrt(centre) / (2 * rate))
    elif high is not None:
        poles, zeros, middle = poles * edges[0], [-1.0], 0.0
    else:
        poles, zeros, middle = edges[0] / poles, [1.0], np.pi
    z = (2 * rate + poles) / (2 * rate - poles)
    upper = sorted((p for p in z if p.imag > 1e-12), key=lambda p: (abs(p), p.imag))
    real = sorted(p.real for p in z if abs(p.imag) <= 1e-12)
    pairs = [(p, p.conjugate()) for p in upper] + [tuple(real[k : k + 2]) for k in range(0, len(real), 2)]
    sections = []
    for pair in pairs:
        of = zeros if len(zeros) == 2 else zeros * len(pair)
        num, den = np.poly(of).real, np.poly(pair).real
        num, den = (np.concatenate([c, np.zeros(3 - len(c))]) for c in (num, den))
        at = np.exp(-1j * middle * np.arange(3))
        num = num / abs((num @ at) / (den @ at))  # each section passes the middle as it is
        sections.append([*num, *den[1:]])
    return np.array(sections)


def run(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(filtered samples, state after them); ``state`` (sections, 2) is what a chunk before left, zeros at first."""
    y = np.asarray(x, float).tolist()
    state = np.zeros((len(sections), 2)) if state is None else np.array(state, float).reshape(len(sections), 2)
    for k, (b0, b1, b2, a1, a2) in enumerate(sections.tolist()):
        u, v = state[k].tolist()
        for i, s in enumerate(y):
            out = b0 * s + u
            u = b1 * s - a1 * out + v
            v = b2 * s - a2 * out
            y[i] = out
        state[k] = u, v
    return np.array(y), state


def response(sections: np.ndarray, rate: float, f: float) -> float:
    """How much of a frequency passes."""
    at = np.exp(-2j * np.pi * f / rate * np.arange(3))
    return float(np.prod([abs((s[:3] @ at) / (np.array([1, *s[3:]]) @ at)) for s in sections]))


def filtered(samples: Column, sections: np.ndarray) -> Column:
    """Each row's array of samples, filtered whole; null stays null."""

    @F.arrow_udf("array<double>")
    def one(batch: pa.Array) -> pa.Array:
        return pa.array([None if not x.is_valid else run(sections, x.values.to_numpy(zero_copy_only=False))[0] for x in batch], pa.list_(pa.float64()))

    return one(samples.cast("array<double>"))


def streamed(chunks: DataFrame, sections: np.ndarray) -> DataFrame:
    """Streams (id, seq, samples) as filtered chunks; chunks of an id are in the order of ``seq``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0]) if state.exists else None
        rows, out = pd.concat(list(batches)).sort_values("seq"), []
        for x in rows["samples"]:
            y, held = run(sections, x, held)
            out.append(y.tolist())
        state.update((held.ravel().tolist(),))
        yield pd.DataFrame({"id": key[0], "seq": rows["seq"].to_numpy(), "samples": out})

    return chunks.groupBy("id").applyInPandasWithState(step, "id long, seq long, samples array<double>", "held array<double>", "append", GroupStateTimeout.NoTimeout)
