"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iou(a: list[str], b: list[str]) -> Column:
    """Intersection over union of two boxes, with 1e-6 in the denominator."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = F.greatest(F.lit(0.0), (F.col(a[2]) - F.col(a[0])) * (F.col(a[3]) - F.col(a[1])))
    other = (F.col(b[2]) - F.col(b[0])) * (F.col(b[3]) - F.col(b[1]))
    return w * h / (area + other - w * h + F.lit(1e-6))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two double arrays."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """A vector over its length, which counts as 1e-9 at least."""
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-9))
    return F.transform(col(v), lambda x: x / n)


def rounded(x: Column | str, digits: int) -> Column:
    """A double to so many decimals as SQL engines count them: scaled, to the nearest whole number (halves away from zero), and back.

    ``F.round`` goes by a double's shortest decimal form instead, which
    may lie on the other side of a half than the scaled number.
    """
    scale = F.lit(float(10**digits))
    return F.round(col(x).cast("double") * scale) / scale


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda s, d: s + d, [(x - y) * (x - y) for x, y in zip(a, b)])


def stride(fps: Column | str, detect_fps: Column | str) -> Column:
    """Frames to step so that the wanted rate is met; halves round to even."""
    return F.greatest(F.lit(1), F.bround(col(fps) / F.greatest(col(detect_fps), F.lit(1e-3))).cast("bigint"))


def digits(text: Column | str) -> Column:
    """The digits of a reading if there are one or two, else an empty string."""
    d = F.regexp_replace(col(text), "[^0-9]", "")
    return F.when(F.length(d).between(1, 2), d).otherwise("")


def safe_name(text: Column | str) -> Column:
    """Letters, digits, dash and underscore kept, 32 characters at most."""
    return F.substring(F.regexp_replace(col(text), "[^A-Za-z0-9_-]", "_"), 1, 32)


def truncated(c: Column) -> Column:
    return c.cast("bigint")


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, w: int, h: int) -> dict[str, Column]:
    """A box cut to whole pixels of the frame."""
    return {
        "cx1": F.greatest(F.lit(0), truncated(x1)), "cy1": F.greatest(F.lit(0), truncated(y1)),
        "cx2": F.least(F.lit(w), truncated(x2)), "cy2": F.least(F.lit(h), truncated(y2)),
    }


#: Places of the body's points (fixed values of the COCO order).
NOSE, EYES, EARS, SHOULDERS, HIPS = 0, (1, 2), (3, 4), (5, 6), (11, 12)


def orientation(conf: Column | str, floor: float = 0.3) -> Column:
    """Which way a person faces, from an array of keypoint confidences."""
    seen = lambda i: col(conf)[i] > floor
    nose, eye, ear = seen(NOSE), seen(EYES[0]) | seen(EYES[1]), seen(EARS[0]) | seen(EARS[1])
    return (
        F.when(~(seen(SHOULDERS[0]) & seen(SHOULDERS[1])), "unknown").when(nose & eye, "front").when(ear & ~nose, "back").otherwise("side")
    )
