"""Recall and share of verified vectors of the neighbour index: python tests/llm/measure_neighbours.py [rows ...]."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from lodestone.llm import neighbours  # noqa: E402


def vectors(rows: int, clusters: int = 0, size: int = 64, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((rows, size))
    if clusters:
        x = rng.standard_normal((clusters, size))[rng.integers(0, clusters, rows)] + 0.2 * x
    return x / np.linalg.norm(x, axis=1)[:, None]


def measured(x: np.ndarray, queries: int = 100, k: int = 20) -> tuple[float, float]:
    index, hit = neighbours.Index(np.arange(len(x)), x), 0
    for i in range(0, len(x), max(1, len(x) // queries)):
        scores = x @ x[i]
        scores[i] = -np.inf
        hit += len(set(np.argpartition(-scores, k)[:k].tolist()) & set(index.search(x[i], i, k)[0].tolist()))
    return hit / index.asked / k, index.verified / index.asked / len(x)


if __name__ == "__main__":
    for rows in map(int, sys.argv[1:] or (10_000, 50_000)):
        for clusters in (0, rows // 100):
            recall, share = measured(vectors(rows, clusters))
            print(f"{rows} vectors, {clusters or 'no'} clusters: recall {recall:.3f}, verified {share:.4f} of all")
