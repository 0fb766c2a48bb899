"""Pixel and model functions: native where the maths allows, otherwise Arrow batches behind a pluggable backend."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hsv_columns(px: DataFrame) -> DataFrame:
    """Hue (0 to 179), saturation and value (0 to 255) of 8-bit ``b, g, r`` columns; other columns are kept."""
    v, low = F.greatest("b", "g", "r"), F.least("b", "g", "r")
    span = v - low
    hue = (
        F.when(span == 0, F.lit(0.0)).when(v == F.col("r"), 60.0 * (F.col("g") - F.col("b")) / span)
        .when(v == F.col("g"), 120 + 60.0 * (F.col("b") - F.col("r")) / span).otherwise(240 + 60.0 * (F.col("r") - F.col("g")) / span)
    )
    hue = F.when(hue < 0, hue + 360).otherwise(hue) / 2
    return px.select("*", (F.floor(hue + F.lit(0.5)) % 180).cast("int").alias("h"), F.when(v == 0, 0).otherwise(F.floor(span * F.lit(255.0) / v + F.lit(0.5))).cast("int").alias("s"), v.alias("v"))


def two_means(v: np.ndarray, rounds: int = 30, eps: float = 0.5) -> np.ndarray:
    """Two centroids by Lloyd's rounds from the two points farthest apart along the widest axis; no randomness."""
    if len(v) < 2:
        return np.stack([v[0] if len(v) else np.full(3, 128.0)] * 2)
    axis = int(v.var(axis=0).argmax())
    c = np.stack([v[v[:, axis].argmin()], v[v[:, axis].argmax()]]).astype(float)
    for _ in range(rounds):
        own = ((v[:, None] - c) ** 2).sum(-1).argmin(1)
        new = np.stack([v[own == i].mean(0) if (own == i).any() else c[i] for i in (0, 1)])
        moved = np.abs(new - c).max()
        c = new
        if moved < eps:
            break
    return c


def cluster_samples(df: DataFrame, keys: str, columns: list[str]) -> DataFrame:
    """Two centroids of each group's samples; for groups that are bounded, such as the samples of a track."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        c = two_means(pdf.sort_values(columns)[columns].to_numpy(float))
        return pd.DataFrame([(key[0], i, *map(float, c[i])) for i in (0, 1)])

    schema = ", ".join([f"{keys} {df.schema[keys].dataType.simpleString()}", "cluster int", *[f"{c} double" for c in columns]])
    return df.groupBy(keys).applyInPandas(run, schema)


def grouped_two_means(df: DataFrame, key: str, columns: list[str], rounds: int = 30, eps: float = 0.5) -> DataFrame:
    """``two_means`` of each group as rounds of grouped sums, for groups of any size: ``key, <column>_0, <column>_1``.

    Only sums are shuffled; a group that moves by less than ``eps`` stands
    still from then on.
    """
    from ..operators.store import materialise

    rows = materialise(df.select(key, *columns))
    wide = F.array(*[F.var_pop(c) for c in columns])
    low = F.array(*[F.min(F.struct(F.col(c).alias("at"), *columns)) for c in columns])
    high = F.array(*[F.min(F.struct((-F.col(c)).alias("at"), *columns)) for c in columns])
    c = rows.groupBy(key).agg(wide.alias("wide"), low.alias("low"), high.alias("high"))
    c = c.withColumn("axis", (F.array_position("wide", F.array_max("wide")) - 1).cast("int"))
    ends = [F.get(end, F.col("axis"))[x].alias(f"{x}_{i}") for i, end in enumerate(("low", "high")) for x in columns]
    c = materialise(c.select(key, *ends, F.lit(False).alias("done")))
    far = [sum(((F.col(x) - F.col(f"{x}_{i}")) * (F.col(x) - F.col(f"{x}_{i}")) for x in columns), F.lit(0.0)) for i in (0, 1)]
    names = [f"{x}_{i}" for i in (0, 1) for x in columns]
    for _ in range(rounds):
        own = rows.join(c.where("not done"), key).withColumn("own", F.when(far[1] < far[0], 1).otherwise(0))
        new = own.groupBy(key).agg(*[F.avg(F.when(F.col("own") == i, F.col(x))).alias(f"new_{x}_{i}") for i in (0, 1) for x in columns])
        both = c.join(new, key, "left")
        moved = F.greatest(*[F.abs(F.coalesce(f"new_{n}", n) - F.col(n)) for n in names], F.lit(0.0))
        c = materialise(both.select(key, *[F.coalesce(f"new_{n}", n).alias(n) for n in names], (F.col("done") | (moved < eps)).alias("done")))
        if c.where("not done").isEmpty():
            break
    return c.drop("done")


def color_clusters(pixels: np.ndarray, k: int = 3, rounds: int = 20, eps: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Centres and sizes by Lloyd's rounds from the mean's farthest pixel on, each next centre the farthest from those before; no randomness."""
    c = [pixels[((pixels - pixels.mean(0)) ** 2).sum(1).argmax()]]
    while len(c) < k:
        c.append(pixels[np.min([((pixels - x) ** 2).sum(1) for x in c], axis=0).argmax()])
    c = np.array(c, float)
    for _ in range(rounds):
        own = ((pixels[:, None] - c) ** 2).sum(-1).argmin(1)
        new = np.stack([pixels[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
        moved = np.abs(new - c).max()
        c = new
        if moved < eps:
            break
    own = ((pixels[:, None] - c) ** 2).sum(-1).argmin(1)
    return c, np.bincount(own, minlength=k)


def dominant(image: np.ndarray, least: int = 30) -> tuple[int, int, int] | None:
    """The centre of the largest colour cluster of a ``(h, w, 3)`` image, among pixels that are neither dark nor blown out."""
    if image.size == 0:
        return None
    value = image.max(2)
    pixels = image[(value > 30) & (value < 245)].astype(float)
    if len(pixels) < least:
        return None
    c, n = color_clusters(pixels, 3 if len(pixels) >= 30 else 1)
    return tuple(int(x) for x in c[int(n.argmax())])


def grid_color(image: np.ndarray, rows: int = 3, cols: int = 2) -> tuple[int, int, int] | None:
    """The mean of the dominant colours of a grid's cells; of the whole image where cells are under six pixels or none has a colour."""
    h, w = image.shape[:2]
    if h < 6 * rows or w < 6 * cols:
        return dominant(image)
    cells = [image[i * h // rows : (i + 1) * h // rows, j * w // cols : (j + 1) * w // cols] for i in range(rows) for j in range(cols)]
    found = [c for c in (dominant(x, 10) for x in cells) if c is not None]
    return tuple(int(x) for x in np.mean(np.array(found, float), axis=0)) if found else dominant(image)


def by_shape(images: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and stacks of the images of each height and width."""
    at: dict[tuple[int, ...], list[int]] = {}
    for i, x in enumerate(images):
        at.setdefault(x.shape[:2], []).append(i)
    for own in at.values():
        yield own, np.stack([images[i] for i in own])


def stacked_clusters(pixels: np.ndarray, ok: np.ndarray, k: int = 3, rounds: int = 20, eps: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """``color_clusters`` of many images at once: of each row of ``(n, p, 3)`` the pixels that are ``ok``, of which there are some."""
    far = lambda c: np.where(ok, ((pixels - c[:, None]) ** 2).sum(-1), -1.0)
    pick = lambda d: pixels[np.arange(len(d)), d.argmax(1)]
    first = pick(far((pixels * ok[..., None]).sum(1) / ok.sum(1)[:, None]))
    c, least = [first], far(first)
    while len(c) < k:
        c.append(pick(least))
        least = np.minimum(least, far(c[-1]))
    c = np.stack(c, 1)

    def owned(p: np.ndarray, at: np.ndarray, good: np.ndarray) -> np.ndarray:
        own = np.stack([((p - at[:, i, None]) ** 2).sum(-1) for i in range(k)], -1).argmin(-1)
        return np.stack([(own == i) & good for i in range(k)], 1)

    live = np.arange(len(pixels))
    for _ in range(rounds):
        own = owned(pixels[live], c[live], ok[live])
        n = own.sum(2)[..., None]
        new = np.where(n > 0, own.astype(float) @ pixels[live] / np.maximum(n, 1), c[live])
        moved = np.abs(new - c[live]).max((1, 2))
        c[live] = new
        live = live[moved >= eps]
        if not len(live):
            break
    return c, owned(pixels, c, ok).sum(2)


def dominants(images: list[np.ndarray], least: int = 30) -> list[tuple[int, int, int] | None]:
    """``dominant`` of many images."""
    out: list[tuple[int, int, int] | None] = [None] * len(images)
    for at, stack in by_shape(images):
        if stack.size == 0:
            continue
        pixels = stack.reshape(len(at), -1, 3)
        value = pixels.max(2)
        ok = (value > 30) & (value < 245)
        n, pixels = ok.sum(1), pixels.astype(float)
        few, many = np.flatnonzero((n >= least) & (n < 30)), np.flatnonzero((n >= least) & (n >= 30))
        for i in few:
            out[at[i]] = tuple(int(x) for x in pixels[i][ok[i]].mean(0))
        if len(many):
            c, size = stacked_clusters(pixels[many], ok[many])
            for i, x in zip(many, c[np.arange(len(many)), size.argmax(1)].astype(int).tolist()):
                out[at[i]] = tuple(x)
    return out


def grid_colors(images: list[np.ndarray], rows: int = 3, cols: int = 2) -> list[tuple[int, int, int] | None]:
    """``grid_color`` of many images."""
    large = [i for i, x in enumerate(images) if x.shape[0] >= 6 * rows and x.shape[1] >= 6 * cols]
    cells = []
    for i in large:
        h, w = images[i].shape[:2]
        cells += [images[i][r * h // rows : (r + 1) * h // rows, c * w // cols : (c + 1) * w // cols] for r in range(rows) for c in range(cols)]
    got = dominants(cells, 10)
    out: list[tuple[int, int, int] | None] = [None] * len(images)
    for n, i in enumerate(large):
        found = [c for c in got[n * rows * cols : (n + 1) * rows * cols] if c is not None]
        if found:
            out[i] = tuple(int(sum(x) / len(found)) for x in zip(*found))
    rest = [i for i, x in enumerate(out) if x is None]
    for i, x in zip(rest, dominants([images[i] for i in rest])):
        out[i] = x
    return out


def crop_colors(df: DataFrame, ident: str = "event_id", batch: int = 4000) -> DataFrame:
    """``ident, b, g, r`` of image columns ``h, w, data`` (bytes, row by row); nulls where there is no colour. ``batch`` images are looked at together."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), batch):
                pdf = whole.iloc[at : at + batch]
                got = [x or (None,) * 3 for x in grid_colors([np.frombuffer(d, np.uint8).reshape(h, w, 3) for h, w, d in zip(pdf["h"], pdf["w"], pdf["data"])])]
                yield pd.DataFrame({ident: pdf[ident].to_numpy(), **{c: pd.array([x[i] for x in got], dtype="Int32") for i, c in enumerate("bgr")}})

    return df.select(ident, "h", "w", "data").mapInPandas(run, f"{ident} {df.schema[ident].dataType.simpleString()}, b int, g int, r int")


def letterboxed_all(images: list[np.ndarray], w: int, h: int) -> np.ndarray:
    """``letterboxed`` of many images."""
    out = np.zeros((len(images), h, w, 3), np.float32)
    for at, stack in by_shape(images):
        ih, iw = stack.shape[1:3]
        scale = min(w / max(iw, 1), h / max(ih, 1))
        nw, nh = max(1, min(w, int(iw * scale))), max(1, min(h, int(ih * scale)))
        y, x = (np.arange(nh) * ih // nh), (np.arange(nw) * iw // nw)
        own = np.zeros((len(at), h, w, 3), np.float32)
        own[:, (h - nh) // 2 : (h - nh) // 2 + nh, (w - nw) // 2 : (w - nw) // 2 + nw] = stack[:, y][:, :, x]
        low, high = own.min((1, 2), keepdims=True), own.max((1, 2), keepdims=True)
        stretch = np.where(high - low > 1e-3, 255.0 / np.maximum(high - low, 1e-3), 1.0)
        out[at] = np.where(high - low > 1e-3, (own - low) * stretch, own) / 255.0
    return out


def letterboxed(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """The image scaled to fit, in the middle of a black canvas, each channel stretched to the full range, from 0 to 1."""
    ih, iw = image.shape[:2]
    scale = min(w / max(iw, 1), h / max(ih, 1))
    nw, nh = max(1, min(w, int(iw * scale))), max(1, min(h, int(ih * scale)))
    y, x = (np.arange(nh) * ih // nh), (np.arange(nw) * iw // nw)
    out = np.zeros((h, w, 3), np.float32)
    out[(h - nh) // 2 : (h - nh) // 2 + nh, (w - nw) // 2 : (w - nw) // 2 + nw] = image[y][:, x]
    low, high = out.min((0, 1)), out.max((0, 1))
    stretch = np.where(high - low > 1e-3, 255.0 / np.maximum(high - low, 1e-3), 1.0)
    return np.where(high - low > 1e-3, (out - low) * stretch, out) / 255.0


def convolution(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Images ``(n, h, w, c)`` under kernels ``(3, 3, c, d)``, padded by one pixel, rectified."""
    n, h, w, c = x.shape
    padded = np.pad(x, ((0, 0), (1, 1), (1, 1), (0, 0)))
    # one product of two matrices: each pixel's surroundings as a row
    near = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(1, 2)).transpose(0, 1, 2, 4, 5, 3).reshape(n * h * w, 9 * c)
    return np.maximum(near @ kernel.reshape(9 * c, -1), 0).reshape(n, h, w, -1)


def contrastive_vectors(images: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Unit vectors of letterboxed images: three convolutions, two of them halved, averages of 4 by 2 cells, two dense layers.

    Weights are ``c1, c2, c3`` (kernels), ``d1, d2`` (dense); they come
    from a checkpoint, which this library does not train.
    """
    x = images
    for name in ("c1", "c2", "c3"):
        x = convolution(x, weights[name])
        if name != "c3":
            n, h, w, c = x.shape
            x = x[:, : h // 2 * 2, : w // 2 * 2].reshape(n, h // 2, 2, w // 2, 2, c).max((2, 4))
    n, h, w, c = x.shape
    cells = [x[:, i * h // 4 : -(-(i + 1) * h // 4), j * w // 2 : -(-(j + 1) * w // 2)].mean((1, 2)) for i in range(4) for j in range(2)]
    z = np.maximum(np.concatenate(cells, 1) @ weights["d1"], 0) @ weights["d2"]
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def stub_weights(size: int = 16, seed: int = 0) -> dict[str, np.ndarray]:
    """Stands in for a checkpoint: weights by a fixed random seed, of the trained network's shapes but for the last layers' size."""
    r = np.random.default_rng(seed)
    shapes = {"c1": (3, 3, 3, 16), "c2": (3, 3, 16, 32), "c3": (3, 3, 32, 64), "d1": (512, 4 * size), "d2": (4 * size, size)}
    return {k: (r.standard_normal(s) / np.sqrt(np.prod(s[:-1]))).astype(np.float32) for k, s in shapes.items()}


def embed_crops(df: DataFrame, backend: Callable[[list[np.ndarray]], np.ndarray], batch: int = 64) -> DataFrame:
    """Adds a vector ``v`` to rows with image columns ``h, w, data``, which go; the backend gets ``batch`` images at once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            images = [np.frombuffer(d, np.uint8).reshape(h, w, 3) for h, w, d in zip(pdf["h"], pdf["w"], pdf["data"])]
            v = [x.tolist() for at in range(0, len(images), batch) for x in np.asarray(backend(images[at : at + batch]), float)]
            yield pdf.drop(columns=["h", "w", "data"]).assign(v=v)

    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name not in ("h", "w", "data"))
    return df.mapInPandas(run, f"{rest}, v array<double>")


def painted(df: DataFrame, ident: str, h: str, w: str, base: list[str]) -> DataFrame:
    """Test images for rows without any: ``h`` by ``w`` pixels about a base colour, with a pattern that depends on the id; other columns are kept."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            data = []
            for e, hh, ww, *bgr in zip(pdf[ident], pdf["h"], pdf["w"], *(pdf[c] for c in base)):
                at = np.arange(hh * ww * 3).reshape(hh, ww, 3)
                data.append(((np.array(bgr) + (at * (e % 7 + 1)) % 23) % 256).astype(np.uint8).tobytes())
            yield pdf.assign(data=data)

    sized = df.withColumns({"h": F.expr(h).cast("int"), "w": F.expr(w).cast("int")})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sized.schema)
    return sized.mapInPandas(run, f"{schema}, data binary")


def two_centroids(df: DataFrame, vector: str, ident: str, rounds: int = 30) -> np.ndarray | None:
    """``two_means`` on all components, the sums made on the executors, until nothing moves; none for an empty table."""

    def total(c: np.ndarray | None) -> dict[int, tuple]:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if len(pdf):
                    v = np.stack(pdf[vector].to_list()).astype(float)
                    own = np.zeros(len(v), int) if c is None else ((v[:, None] - c) ** 2).sum(-1).argmin(1)
                    for i in np.unique(own):
                        x = v[own == i]
                        yield pd.DataFrame({"team": [int(i)], "n": [len(x)], "s": [x.sum(0).tolist()], "q": [(x**2).sum(0).tolist()]})

        part = df.select(vector).mapInPandas(run, "team int, n bigint, s array<double>, q array<double>")
        part = part.select("team", "n", F.posexplode(F.arrays_zip("s", "q")).alias("i", "x"))
        sums = part.groupBy("team", "i").agg(F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.q").alias("q"))
        out: dict[int, tuple] = {}
        rows = sorted(sums.collect(), key=lambda r: (r["team"], r["i"]))  # a row for each component of two centroids
        for team in {r["team"] for r in rows}:
            own = [r for r in rows if r["team"] == team]
            out[team] = (own[0]["n"], np.array([r["s"] for r in own]), np.array([r["q"] for r in own]))
        return out

    every = total(None)
    if not every:
        return None
    n, s, q = every[0]
    at = F.col(vector)[int((q / n - (s / n) ** 2).argmax())]
    c = np.array([df.orderBy(o, ident).select(vector).first()[0] for o in (at.asc(), at.desc())], float)
    for _ in range(rounds):
        got = total(c)
        new = np.stack([got[i][1] / got[i][0] if i in got else c[i] for i in (0, 1)])
        moved = np.abs(new - c).max()
        c = new
        if moved < 1e-9:
            break
    return c


def nearest_of_two(df: DataFrame, vector: str, c: np.ndarray | None) -> DataFrame:
    """Adds the ``team`` of the nearer centroid; the first of equals, and 0 where there is none."""
    if c is None:
        return df.withColumn("team", F.lit(0))
    far = [F.aggregate(F.zip_with(vector, F.array(*map(F.lit, x.tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d) for x in c]
    return df.withColumn("team", F.when(far[1] < far[0], 1).otherwise(0))


Backend = Callable[[list[bytes]], list[tuple[str, float]]]


def stub_reader(images: list[bytes]) -> list[tuple[str, float]]:
    """Stands in for an OCR model: the bytes' sum as a two-digit reading."""
    return [(str(sum(x) % 100), (sum(x) % 10) / 10) for x in images]


def read_numbers(df: DataFrame, image: str, backend: Backend = stub_reader, batch: int = 32) -> DataFrame:
    """Text and confidence of each image; the backend gets ``batch`` images at once, in Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            images = [bytes(x) for x in pdf[image]]
            got = [r for at in range(0, len(images), batch) for r in backend(images[at : at + batch])]
            yield pdf.drop(columns=[image]).assign(text=[t for t, _ in got], conf=[c for _, c in got])

    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != image)
    return df.mapInPandas(run, f"{rest}, text string, conf double")


def linear_head(df: DataFrame, vector: str, weights: list[float], bias: float) -> DataFrame:
    """A one-layer head's sigmoid of an embedding column, as a Column expression."""
    w = F.array(*map(F.lit, weights))
    z = F.aggregate(F.zip_with(vector, w, lambda x, y: x.cast("double") * y), F.lit(float(bias)), lambda s, x: s + x)
    return df.withColumn("score", 1 / (1 + F.exp(-z)))


def mlp_head(df: DataFrame, vector: str, first: np.ndarray, second: np.ndarray) -> DataFrame:
    """A two-layer head: rectified hidden units, then the sigmoid of their weighted sum, in Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                x = np.stack(pdf[vector].to_list()).astype(float)
                z = np.maximum(x @ first, 0) @ second
                yield pdf.drop(columns=[vector]).assign(score=1 / (1 + np.exp(-z)))

    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != vector)
    return df.mapInPandas(run, f"{rest}, score double")


def infer_poses(df: DataFrame, backend: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """From each frame to any number of poses ``(frame, pose_idx, x1, y1, x2, y2, conf)``; the backend sees Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield backend(pdf)

    return df.mapInPandas(run, "frame bigint, pose_idx int, x1 double, y1 double, x2 double, y2 double, conf double")


def stub_poses(frames: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a pose model: as many poses as the frame's number modulo three."""
    rows = [(f, i, 10.0 * i, 0.0, 10.0 * i + 40, 80.0, 0.5) for f in frames["frame"] for i in range(f % 3)]
    return pd.DataFrame(rows, columns=["frame", "pose_idx", "x1", "y1", "x2", "y2", "conf"]).astype({"frame": "int64", "pose_idx": "int32"})
