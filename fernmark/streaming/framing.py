"""Frames of a stream of sample chunks: state carries the samples that the next frame still needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAME_SCHEMA = "id long, frame long, start long, samples array<double>"
STATE_SCHEMA = "next_start long, frames long, held array<double>"


def cut(held: np.ndarray, size: int, hop: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Whole frames, and the samples from the next frame's start on."""
    n = max(0, (len(held) - size) // hop + 1)
    return [held[k * hop : k * hop + size] for k in range(n)], held[n * hop :]


def frames(chunks: DataFrame, size: int, hop: int) -> DataFrame:
    """Streams (id, seq, samples) as frames; chunks of an id are in the order of ``seq`` within a batch.

    However a recording is cut into chunks, its frames are those of the whole.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, made, held = state.get if state.exists else (0, 0, [])
        rows = pd.concat(list(batches)).sort_values("seq")
        samples = np.concatenate([np.asarray(held, float), *[np.asarray(x, float) for x in rows["samples"]]])
        found, rest = cut(samples, size, hop)
        state.update((int(start + len(found) * hop), int(made + len(found)), rest.tolist()))
        if found:
            yield pd.DataFrame({"id": key[0], "frame": made + np.arange(len(found)), "start": start + hop * np.arange(len(found)), "samples": [f.tolist() for f in found]})

    return chunks.groupBy("id").applyInPandasWithState(step, FRAME_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
