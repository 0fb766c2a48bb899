"""Tracking by detection: boxes of successive frames joined into tracks.

The order of frames matters only as far as a track is remembered, so runs
are cut into chunks of frames that overlap. Chunks are tracked on their
own; two tracks of neighbouring chunks that share boxes where the chunks
overlap, each more with the other than with any third, are one, and
chains of them are connected components.

Within a chunk a frame's sure boxes are matched first, with all tracks,
then its unsure ones with those that were seen last; each by the
assignment of least total cost. Tracks move between frames by a filter of
constant velocity.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import materialise


@dataclass(frozen=True)
class Settings:
    """Scores of sure and unsure boxes and of new tracks; frames that a lost track is kept; cost limits of the three matchings."""

    high: float = 0.25
    low: float = 0.1
    fresh: float = 0.25
    buffer: int = 180
    match: float = 0.9
    second: float = 0.5
    tentative: float = 0.7


#: Deviations of place and velocity, in heights of the box (fixed values of the public filter).
PLACE, SPEED = 1 / 20, 1 / 160


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of ``a`` with every box of ``b``."""
    side = np.maximum(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0)
    both = side.prod(2)
    area = lambda x: np.maximum(x[:, 2:] - x[:, :2], 0).prod(1)
    return both / np.maximum(area(a)[:, None] + area(b)[None, :] - both, 1e-9)


def assign(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs of rows and columns for which the sum of what they cost less than ``most`` is largest; shortest augmenting paths.

    The fewer side is led to the other, of which only what some row may
    take is looked at: a frame has few boxes and many tracks to remember.
    """
    n, m = cost.shape
    if n > m:
        return sorted((i, j) for j, i in assign(cost.T, most))
    near = np.flatnonzero((cost <= most).any(0))
    if len(near) < m:
        return [(i, int(near[j])) for i, j in assign(cost[:, near], most)] if len(near) else []
    # a row may go to a column of its own at no gain
    gain = np.concatenate([np.minimum(cost - most, 0), np.zeros((n, n))], axis=1)
    u, v = np.zeros(n), np.zeros(m + n)
    owner = np.full(m + n, -1)
    for i in range(n):
        free = np.ones(m + n, bool)
        least, came = np.full(m + n, np.inf), np.full(m + n, -1)
        row, at = i, -1
        while True:
            slack = gain[row] - u[row] - v
            better = free & (slack < least)
            least[better], came[better] = slack[better], at
            j = int(np.where(free, least, np.inf).argmin())
            step = least[j]
            # potentials of all that the search has reached move along
            u[i] += step
            done = ~free
            u[owner[done]] += step
            v[done] -= step
            least[free] -= step
            free[j], at = False, j
            if owner[j] < 0:
                break
            row = owner[j]
        while at >= 0:
            owner[at] = owner[came[at]] if came[at] >= 0 else i
            at = came[at]
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0 and cost[owner[j], j] <= most)


@dataclass
class Tracks:
    """All live tracks of a chunk: names, filters of middle and size, when each was last seen, and whether it is confirmed."""

    name: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    mean: np.ndarray = field(default_factory=lambda: np.zeros((0, 4, 2)))
    cov: np.ndarray = field(default_factory=lambda: np.zeros((0, 4, 2, 2)))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sure: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def keep(self, which: np.ndarray) -> None:
        for k in ("name", "mean", "cov", "seen", "sure"):
            setattr(self, k, getattr(self, k)[which])

    def predict(self, frames: int) -> None:
        """Move all tracks on by a number of frames."""
        noise = np.maximum(self.mean[:, 3, 0], 1.0) ** 2 * frames
        self.mean[:, :, 0] += frames * self.mean[:, :, 1]
        turn = np.array([[1.0, frames], [0.0, 1.0]])
        self.cov = turn @ self.cov @ turn.T
        self.cov[:, :, 0, 0] += (PLACE**2 * noise)[:, None]
        self.cov[:, :, 1, 1] += (SPEED**2 * noise)[:, None]

    def boxes(self) -> np.ndarray:
        middle, size = self.mean[:, :2, 0], np.maximum(self.mean[:, 2:, 0], 1e-3)
        return np.concatenate([middle - size / 2, middle + size / 2], axis=1)

    def correct(self, which: np.ndarray, z: np.ndarray, frame: int) -> None:
        """Take in the boxes ``z`` that some tracks were matched with."""
        error = self.cov[which, :, 0, 0] + (PLACE * np.maximum(self.mean[which, 3, 0], 1.0))[:, None] ** 2
        weight = self.cov[which, :, :, 0] / error[:, :, None]
        self.mean[which] += weight * (z - self.mean[which, :, 0])[:, :, None]
        self.cov[which] -= weight[:, :, :, None] * self.cov[which, :, 0, None, :]
        self.seen[which], self.sure[which] = frame, True

    def begin(self, names: np.ndarray, z: np.ndarray, frame: int, sure: bool) -> None:
        mean = np.stack([z, np.zeros_like(z)], axis=2)
        height = np.maximum(z[:, 3], 1.0) ** 2
        cov = np.zeros((len(z), 4, 2, 2))
        cov[:, :, 0, 0], cov[:, :, 1, 1] = (4 * PLACE**2 * height)[:, None], (100 * SPEED**2 * height)[:, None]
        new = {"name": names, "mean": mean, "cov": cov, "seen": np.full(len(z), frame), "sure": np.full(len(z), sure)}
        for k, x in new.items():
            setattr(self, k, np.concatenate([getattr(self, k), x]))


def follow(frames: np.ndarray, boxes: np.ndarray, scores: np.ndarray, settings: Settings) -> np.ndarray:
    """The track of each box, in order of frames; -1 for boxes in no track."""
    track, tracks, made, now = np.full(len(frames), -1, np.int64), Tracks(), 0, None
    z = np.concatenate([(boxes[:, :2] + boxes[:, 2:]) / 2, boxes[:, 2:] - boxes[:, :2]], axis=1)
    for rows in np.split(np.arange(len(frames)), np.flatnonzero(np.diff(frames)) + 1) if len(frames) else ():
        frame, first = int(frames[rows[0]]), now is None
        if not first:
            tracks.keep(frame - tracks.seen <= settings.buffer)
            tracks.predict(frame - now)
        before, now = now, frame
        high, low = rows[scores[rows] >= settings.high], rows[(scores[rows] >= settings.low) & (scores[rows] < settings.high)]
        where, taken = tracks.boxes(), np.zeros(len(tracks.name), bool)

        def join(own: np.ndarray, at: np.ndarray, most: float, fused: bool) -> np.ndarray:
            """Match tracks with boxes; returns the boxes that are left."""
            if not len(own) or not len(at):
                return at
            near = overlaps(where[own], boxes[at])
            pairs = np.array(assign(1 - (near * scores[at] if fused else near), most), int).reshape(-1, 2)
            which, got = own[pairs[:, 0]], at[pairs[:, 1]]
            tracks.correct(which, z[got], frame)
            track[got], taken[which] = tracks.name[which], True
            return np.setdiff1d(at, got)

        sure = tracks.sure.copy()
        recent = tracks.seen == before if before is not None else np.zeros(0, bool)
        high = join(np.flatnonzero(sure), high, settings.match, True)
        join(np.flatnonzero(sure & ~taken & recent), low, settings.second, False)
        high = join(np.flatnonzero(~sure), high, settings.tentative, True)
        tracks.keep(taken | sure)
        new = high[scores[high] >= settings.fresh]
        names = made + np.arange(len(new))
        made += len(new)
        track[new] = names
        tracks.begin(names, z[new], frame, first)
    return track


def track_boxes(det: DataFrame, run: str, chunk: int = 1000, overlap: int = 200, settings: Settings = Settings()) -> DataFrame:
    """``event_id, track`` of boxes ``(run, frame, event_id, x1, y1, x2, y2, score)``; tracks are named by run, chunk and number.

    A chunk of ``chunk + overlap`` frames of one run is one task's group.
    Boxes of no track have a null one; rows with a null frame, box or
    score are in none and left out. Of boxes of one frame the order is by
    ``event_id``.
    """
    columns = ["x1", "y1", "x2", "y2", "score"]
    d = det.select(F.col(run).alias("run"), "frame", "event_id", *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    own = F.floor(F.col("frame") / chunk)
    both = F.when((own > 0) & (F.pmod(F.col("frame"), F.lit(chunk)) < overlap), F.array(own, own - 1)).otherwise(F.array(own))
    kind = d.schema["run"].dataType.simpleString()

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "event_id"], ignore_index=True)
        got = follow(pdf["frame"].to_numpy(), pdf[columns[:4]].to_numpy(), pdf["score"].to_numpy(), settings)
        return pdf[["run", "chunk", "event_id"]].assign(main=pdf["frame"] // chunk == key[1], track=got)

    local = d.withColumn("chunk", F.explode(both)).groupBy("run", "chunk").applyInPandas(one, f"run {kind}, chunk bigint, event_id bigint, main boolean, track bigint")
    local = local.withColumn("node", F.when(F.col("track") >= 0, F.concat_ws(":", "run", F.lpad(F.col("chunk").cast("string"), 9, "0"), F.lpad(F.col("track").cast("string"), 9, "0"))))
    local = materialise(local)
    met = local.where("node is not null")
    later = met.where("main").select("run", (F.col("chunk") - 1).alias("chunk"), "event_id", F.col("node").alias("dst"))
    shared = met.where("not main").select("run", "chunk", "event_id", F.col("node").alias("src")).join(later, ["run", "chunk", "event_id"])
    shared = materialise(shared.groupBy("src", "dst").agg(F.count("*").alias("n")))
    best = lambda a, b: shared.groupBy(a).agg(F.min_by(b, F.struct(-F.col("n"), b)).alias(b))
    edges = best("src", "dst").join(best("dst", "src"), ["src", "dst"])
    name = connected_components(edges)
    # where chunks overlap the earlier one has seen more
    out = local.groupBy("run", "event_id").agg(F.min("node").alias("node")).join(name, "node", "left")
    return out.select("event_id", F.coalesce("component", "node").alias("track"))
