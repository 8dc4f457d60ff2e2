"""Small-target detection on intensity grids.

frames: frame_id, grid array<array<double>>, a row for each frame, so frames
are the unit of work and a frame's pixels never leave its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CELLS = 8
#: Pixels of frames of one shape that are looked at together.
TOGETHER = 1 << 16


def _ring_snr(grids: np.ndarray, guard: int, train: int) -> np.ndarray:
    """Signal to noise of every pixel of grids of one shape (frame, row, col): over
    the ring of training cells around it, the mean and then the deviations from
    that mean are added up cell by cell, as differences of large sums would cost
    places.  Minus infinity where the ring has too few cells or all alike."""
    reach, (_, height, width) = guard + train, grids.shape
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if max(abs(i), abs(j)) > guard and abs(i) < height and abs(j) < width]

    def pairs():
        """For each step the pixels that have a cell there, and these cells."""
        for i, j in steps:
            own = np.s_[:, max(0, -i) : height - max(0, i), max(0, -j) : width - max(0, j)]
            yield own, np.s_[:, max(0, i) : height + min(0, i), max(0, j) : width + min(0, j)]

    n, mean, square = np.zeros(grids.shape), np.zeros(grids.shape), np.zeros(grids.shape)
    for own, cell in pairs():
        n[own] += 1
        mean[own] += grids[cell]
    mean /= np.maximum(n, 1)
    for own, cell in pairs():
        square[own] += (grids[cell] - mean[own]) ** 2
    sd = np.sqrt(square / np.maximum(n, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((n >= MIN_CELLS) & (sd > 1e-9), (grids - mean) / sd, -np.inf)


def _hits(snr: np.ndarray, k: float) -> list[tuple[int, int, float]]:
    return [(int(r), int(c), float(snr[r, c])) for r, c in np.argwhere(snr >= k)]


def cfar(grid: np.ndarray, guard: int = 1, train: int = 4, k: float = 5.0) -> list[tuple[int, int, float]]:
    """row, col, signal to noise of pixels above the mean of the ring of
    training cells around them by k of its deviations."""
    if grid.size == 0:
        return []
    return _hits(_ring_snr(grid[None], guard, train)[0], k)


def blobs(hits: list[tuple[int, int, float]], k: float = 5.0, max_size: int = 8) -> list[dict]:
    """Connected hits (8 neighbours) of no more than max_size pixels, the most
    confident first."""
    left = {(r, c): s for r, c, s in hits}
    out = []
    while left:
        first = next(iter(left))
        group, edge = {first: left.pop(first)}, [first]
        while edge:
            r, c = edge.pop()
            for q in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    group[q] = left.pop(q)
                    edge.append(q)
        if len(group) <= max_size:
            n, peak = len(group), max(group.values())
            confidence = min(0.99, peak / (2 * k) / (1 + 0.15 * (n - 1)))
            out.append({"row": round(sum(p[0] for p in group) / n, 2), "col": round(sum(p[1] for p in group) / n, 2), "size": n, "peak_snr": round(peak, 2), "confidence": round(confidence, 4)})
    return sorted(out, key=lambda b: -b["confidence"])


def detect_targets(frames: DataFrame, k: float = 5.0, guard: int = 1, train: int = 4, max_size: int = 8, apart: bool = False) -> DataFrame:
    """frame_id, rank, row, col, size, peak_snr, confidence.  apart: every pixel
    that is hit is a target of its own, and the first of it."""

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out, alike = [], {}
            for at, grid in enumerate(rows["grid"]):
                if grid is not None and len(grid):
                    pixels = np.array([np.asarray(r, float) for r in grid])
                    if pixels.size:
                        alike.setdefault(pixels.shape, []).append((at, pixels))
            for (height, width), frames_ in alike.items():
                step = max(1, TOGETHER // (height * width))
                for first in range(0, len(frames_), step):
                    some = frames_[first : first + step]
                    for (at, _), snr in zip(some, _ring_snr(np.stack([g for _, g in some]), guard, train), strict=True):
                        hits = _hits(snr, k)
                        for group in [[h] for h in hits] if apart else [hits]:
                            out += [{"frame_id": rows["frame_id"].iloc[at], "rank": i, **b} for i, b in enumerate(blobs(group, k, max_size))]
            yield pd.DataFrame(out, columns=["frame_id", "rank", "row", "col", "size", "peak_snr", "confidence"])

    schema = f"frame_id {dict(frames.dtypes)['frame_id']}, rank int, row double, col double, size int, peak_snr double, confidence double"
    return frames.select("frame_id", "grid").mapInPandas(detect, schema)


def media_reports(frames: DataFrame, source: str = "captured-media", k: float = 5.0, apart: bool = False) -> DataFrame:
    """A report for each frame (apart: for each pixel that is hit, if there are
    several); its id holds the frame's, so that frames with equal findings stay
    apart."""
    t = detect_targets(frames, k, apart=apart).groupBy("frame_id", *["row", "col"] * apart).agg(F.array_sort(F.collect_list(F.struct("rank", "row", "col", "peak_snr"))).alias("t")).select("frame_id", "t")
    both = frames.select("frame_id").join(t, "frame_id", "left")
    spots = F.array_join(F.transform(F.slice("t", 1, 5), lambda b: F.concat(F.lit("("), b["row"].cast("string"), F.lit(","), b["col"].cast("string"), F.lit(")"))), ", ")
    some = F.concat(F.size("t").cast("string"), F.lit(" small bright target(s) at "), spots, F.lit("; peak signal to noise "), F.col("t")[0]["peak_snr"].cast("string"), F.lit("."))
    text = F.when(F.col("t").isNull(), "No small bright target in the frame.").otherwise(some)
    both = both.withColumn("text", text)
    return both.select(F.concat(F.lit("media-"), F.substring(F.sha1(F.concat_ws("|", F.col("frame_id").cast("string"), "text")), 1, 10)).alias("id"), "frame_id", F.lit("").alias("timestamp"), F.lit(source).alias("source"), "text")
