"""Comparison of whole trajectories by banded dynamic time warping, a pair of bounded length at a time; Spark deals the pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAND, SCALE = 0.2, 1.5


def warped_distance(a: np.ndarray, b: np.ndarray, band: float = BAND) -> float:
    """Sum of Euclidean distances along the best warping path inside a Sakoe-Chiba band; ``a`` and ``b`` have a row a frame.

    Cells of one anti-diagonal depend on the two before only, so each is one vector operation.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float("inf")
    reach = max(1, int(band * max(n, m)))
    if abs(n - m) > reach:  # no path inside the band
        return float("inf")
    cost = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)  # by row, of diagonals d - 2 and d - 1
    before[0] = 0.0
    for d in range(2, n + m + 1):
        rows = np.arange(max(1, d - m, -(-(d - reach) // 2)), min(n, d - 1, (d + reach) // 2) + 1)
        now = np.full(n + 1, np.inf)
        if len(rows):
            now[rows] = cost[rows - 1, d - rows - 1] + np.minimum(np.minimum(last[rows - 1], last[rows]), before[rows - 1])
        before, last = last, now
    return float(last[n])


def dtw_confidence(pairs: DataFrame, scale: float = SCALE) -> DataFrame:
    """query, reference, confidence of pairs with trajectories ``a`` and ``b`` (arrays of frame arrays)."""

    def run(batches):
        for batch in batches:
            found = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                x, y = (np.array([list(f) for f in side], dtype=float).reshape(len(side), -1) for side in (a, b))
                found.append(max(0.0, 1.0 - warped_distance(x, y) / max(len(x), len(y), 1) / scale))
            yield pd.DataFrame({"query": batch["query"], "reference": batch["reference"], "confidence": found})

    return pairs.select("query", "reference", "a", "b").mapInPandas(run, "query long, reference long, confidence double")


def _envelope_bound(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """No more than the warped distance: each frame of ``a`` is at least as far from all it may meet as from their box."""
    off = np.maximum(np.maximum(low - a, a - high), 0.0)
    return float(np.sqrt((off * off).sum(axis=1)).sum())


def _envelopes(b: np.ndarray, n: int, band: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` frames the least and largest values of the frames of ``b`` that the band lets it meet."""
    reach = max(1, int(band * max(n, len(b))))
    spans = [(max(0, i - reach), min(len(b), i + reach + 1)) for i in range(n)]
    return np.array([b[s:e].min(axis=0) for s, e in spans]), np.array([b[s:e].max(axis=0) for s, e in spans])


def nearest_reference(query: np.ndarray, references: list[tuple[object, np.ndarray]], scale: float = SCALE, band: float = BAND) -> tuple[object, float, int]:
    """The reference of the highest confidence, the first of equals, its confidence, and how many were compared in full.

    References are tried in the order of a lower bound of their distance, until the bound alone rules the rest out.
    """
    bounds = []
    for key, b in references:
        size = max(len(query), len(b), 1)
        reach = max(1, int(band * max(len(query), len(b))))
        possible = len(query) and len(b) and abs(len(query) - len(b)) <= reach
        bound = _envelope_bound(query, *_envelopes(b, len(query), band)) if possible else float("inf")
        # a little is left for rounding, so a bound never rules out an equal
        bounds.append((max(0.0, 1.0 - bound / size / scale) * (1 + 1e-12) + 1e-12, key, b, size))
    best, compared = (None, -1.0), 0
    for most, key, b, size in sorted(bounds, key=lambda x: -x[0]):
        if most < best[1]:
            break
        compared += 1
        sure = max(0.0, 1.0 - warped_distance(query, b, band) / size / scale)
        if sure > best[1] or sure == best[1] and key < best[0]:
            best = (key, sure)
    return best[0], best[1], compared


#: Runs of a block; two blocks meet in one task.
BLOCK = 64


def _blocks(runs: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``name`` and its runs (run, trajectory) as rows of ``BLOCK`` runs or so; the number of blocks."""
    n = max(1, -(-runs.count() // BLOCK))
    return runs.withColumn(name, F.pmod(F.xxhash64("run"), F.lit(n))), n


def best_by_warping(queries: DataFrame, references: DataFrame, least: float = 0.3, scale: float = SCALE, other_runs: bool = False) -> DataFrame:
    """query, reference, confidence of the surest of ``references`` for each of ``queries`` (run, trajectory), if it reaches ``least``.

    Queries meet the references a block at a time: the references' block is the key, each block of queries goes to every one, and within
    a task envelopes rule most of them out.  With ``other_runs`` a query does not meet the reference of its own run.
    """
    asked, n_query = _blocks(queries, "query_block")
    known, n_known = _blocks(references, "known_block")
    spread = asked.select("query_block", F.lit(True).alias("asks"), "run", "trajectory", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_known - 1).cast("long"))).alias("known_block"))
    held = known.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query - 1).cast("long"))).alias("query_block"), F.lit(False).alias("asks"), "run", "trajectory", "known_block")

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        shown = [np.array([list(f) for f in t], dtype=float).reshape(len(t), -1) for t in frame["trajectory"]]
        asks = frame["asks"].to_numpy(bool)
        runs = frame["run"].tolist()
        there = [(runs[k], shown[k]) for k in np.flatnonzero(~asks)]
        found = []
        for k in np.flatnonzero(asks):
            own = [r for r in there if r[0] != runs[k]] if other_runs else there
            if own:
                found.append((runs[k], *nearest_reference(shown[k], own, scale)[:2]))
        return pd.DataFrame(found, columns=["query", "reference", "confidence"])

    met_rows = spread.unionByName(held).groupBy("query_block", "known_block").applyInPandas(met, "query long, reference long, confidence double")
    return best_reference(met_rows, least)


def best_reference(compared: DataFrame, least: float = 0.3) -> DataFrame:
    """query, reference, confidence of each query's surest reference, the first of equals, if it reaches ``least``."""
    best = compared.groupBy("query").agg(F.max_by("reference", F.struct("confidence", -F.col("reference"))).alias("reference"), F.max("confidence").alias("confidence"))
    return best.filter(F.col("confidence") >= least)


def trajectories(frames: DataFrame, columns: list[str]) -> DataFrame:
    """run, trajectory: each run's frames in order, as arrays of the given columns."""
    cells = F.struct("idx", F.array(*columns).alias("f"))
    return frames.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(cells)), lambda c: c["f"]).alias("trajectory"))
