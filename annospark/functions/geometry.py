"""Box arithmetic as Column expressions. Nothing here leaves the JVM."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, functions as F

Box = namedtuple("Box", "x1 y1 x2 y2")

# The overlap limits that define a duplicate, a nested box and a saved duplicate.
CONTAINED_FROM = 0.80
NMS_OVER = 0.45
DEDUP_OVER = 0.55
EMPTY_SIDE = 1e-6


def box(source: str | Column | None = None, suffix: str = "") -> Box:
    """Corner columns of the current row, of a join alias, or of a struct column."""
    if source is None:
        return Box(*(F.col(name + suffix) for name in Box._fields))
    if isinstance(source, str):
        return Box(*(F.col(f"{source}.{name}{suffix}") for name in Box._fields))
    return Box(*(source.getField(name) for name in Box._fields))


def _positive(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def area(b: Box) -> Column:
    return _positive(b.x2 - b.x1) * _positive(b.y2 - b.y1)


def shared_area(a: Box, b: Box) -> Column:
    across = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    down = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return _positive(across) * _positive(down)


def touches(a: Box, b: Box) -> Column:
    """Cheap necessary condition for a positive shared area, put first in join conditions."""
    return (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; two boxes without area have overlap 0."""
    both = shared_area(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def containment(inner: Box, outer: Box) -> Column:
    """Share of ``inner`` that lies inside ``outer``."""
    return F.coalesce(F.try_divide(shared_area(inner, outer), area(inner)), F.lit(0.0))


def nested(a: Box, b: Box) -> Column:
    return (containment(a, b) >= CONTAINED_FROM) | (containment(b, a) >= CONTAINED_FROM)


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def corners_to_centre(b: Box) -> tuple[Column, Column, Column, Column]:
    """(cx, cy, w, h) of a corner box."""
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, b.x2 - b.x1, b.y2 - b.y1


def between(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(value, high))


def clip_to(b: Box, width: Column, height: Column) -> Box:
    """Clip corners to the frame ``[0, width] x [0, height]``."""
    return Box(
        between(b.x1, 0.0, width),
        between(b.y1, 0.0, height),
        between(b.x2, 0.0, width),
        between(b.y2, 0.0, height),
    )


def has_extent(b: Box) -> Column:
    return (b.x2 > b.x1) & (b.y2 > b.y1)


def pixels_from_centre(cx, cy, w, h, width: Column, height: Column) -> Box:
    """Normalised centre box to clipped pixel corners; keep only rows where ``has_extent``."""
    wide, high = w * width, h * height
    left, top = cx * width - wide / 2, cy * height - high / 2
    return clip_to(Box(left, top, left + wide, top + high), width.cast("double"), height.cast("double"))


def centre_from_pixels(b: Box, width: Column, height: Column):
    """Pixel corners to a normalised centre box (cx, cy, w, h)."""
    return (
        (b.x1 + b.x2) / 2 / width,
        (b.y1 + b.y2) / 2 / height,
        (b.x2 - b.x1) / width,
        (b.y2 - b.y1) / height,
    )


def clip_centre(cx, cy, w, h):
    """Clip a normalised centre box to the unit frame.

    Returns ``(cx, cy, w, h, usable)``; a box whose clipped side is at most ``EMPTY_SIDE`` is not
    usable and must be filtered out by the caller.
    """
    one = F.lit(1.0)
    c = clip_to(centre_to_corners(cx, cy, w, h), one, one)
    mid_x, mid_y, wide, high = corners_to_centre(c)
    return mid_x, mid_y, wide, high, (wide > EMPTY_SIDE) & (high > EMPTY_SIDE)


def crop_window(b: Box, width: Column, height: Column) -> Box:
    """Whole-pixel crop box. The start is limited to the last pixel, the end to the frame size."""
    first = lambda value, size: between(value.cast("int"), F.lit(0), size - 1)
    last = lambda value, size: between(value.cast("int"), F.lit(0), size)
    return Box(first(b.x1, width), first(b.y1, height), last(b.x2, width), last(b.y2, height))


def crop_window_float(b: Box, width: Column, height: Column) -> Box:
    """Crop box in floating point: corners are put in order first, then clipped."""
    ordered = Box(F.least(b.x1, b.x2), F.least(b.y1, b.y2), F.greatest(b.x1, b.x2), F.greatest(b.y1, b.y2))
    return clip_to(ordered, width.cast("double"), height.cast("double"))


def rescale(b: Box, sx, sy) -> Box:
    return Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy)


# The augmented views a detector is run on, and the size factor of each.
VIEW_FACTORS = {"original": None, "hflip": None, "scale_0.8": 0.8, "scale_1.2": 1.2}


def to_original_frame(b: Box, view: Column, width: Column, height: Column) -> Box:
    """Boxes found on an augmented view, back in the frame of the original image.

    The scaled views have a whole-pixel size, so the factor back is original / truncated size.
    """
    mirrored = Box(width - b.x2, b.y1, width - b.x1, b.y2)
    out = list(b)
    for name, factor in VIEW_FACTORS.items():
        if name == "hflip":
            moved = mirrored
        elif factor is not None:
            moved = rescale(
                b,
                width / (width * F.lit(factor)).cast("int"),
                height / (height * F.lit(factor)).cast("int"),
            )
        else:
            continue
        out = [F.when(view == name, new).otherwise(old) for new, old in zip(moved, out)]
    return Box(*out)


def named(b: Box, suffix: str = "") -> list[Column]:
    """Alias the four corners for a select list."""
    return [value.alias(name + suffix) for name, value in zip(Box._fields, b)]
