"""Integer histograms per key, counted in tasks and summed by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCHEMA = "key string, feature int, n long"


class Tally:
    """Histograms of one task; at most ``keys`` of them are held before they are handed on."""

    def __init__(self, size: int, keys: int = 64):
        self.size, self.keys, self.held = size, keys, {}

    def add(self, key: str, features: np.ndarray, weights: np.ndarray | None = None) -> None:
        got = np.bincount(features, weights=weights, minlength=self.size).astype(np.int64)
        self.held[key] = self.held[key] + got if key in self.held else got

    def full(self) -> bool:
        return len(self.held) > self.keys

    def flush(self) -> Iterator[pa.RecordBatch]:
        for key, counts in self.held.items():
            features = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(features), pa.string()), pa.array(features.astype(np.int32)), pa.array(counts[features])],
                names=["key", "feature", "n"],
            )
        self.held = {}
