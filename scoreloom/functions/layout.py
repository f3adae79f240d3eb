"""Rectangles on a page: visibility, overlap, fitting and precedence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]
OVERLAP, SAME_VISUAL, MARGIN, PREVIEW_SHARE, PREVIEW_EDGE = 0.8, 0.85, 4, 0.45, 160


def box(name: str) -> Box:
    """Left, top, right and bottom of a struct column."""
    return tuple(F.col(f"{name}.{k}") for k in ("left", "top", "right", "bottom"))


def _span(lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0.0), hi - lo)


def area(b: Box) -> Column:
    return _span(b[0], b[2]) * _span(b[1], b[3])


def common_area(a: Box, b: Box) -> Column:
    return _span(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * _span(F.greatest(a[1], b[1]), F.least(a[3], b[3]))


def smaller_overlap(a: Box, b: Box) -> Column:
    """Common area as a share of the smaller box, 0 where that is empty."""
    return F.coalesce(common_area(a, b) / F.nullif(F.least(area(a), area(b)), F.lit(0.0)), F.lit(0.0))


def in_viewport(b: Box, width: Column, height: Column) -> Column:
    return (b[3] > 0) & (b[2] > 0) & (b[1] < height) & (b[0] < width)


def visible_area(b: Box, width: Column, height: Column) -> Column:
    return _span(F.greatest(b[0], F.lit(0.0)), F.least(b[2], width)) * _span(F.greatest(b[1], F.lit(0.0)), F.least(b[3], height))


def centre_distance(b: Box, width: Column, height: Column) -> Column:
    x = (F.greatest(b[0], F.lit(0.0)) + F.least(b[2], width)) / 2 - width / 2
    y = (F.greatest(b[1], F.lit(0.0)) + F.least(b[3], height)) / 2 - height / 2
    return x * x + y * y


def viewport_order(b: Box, width: Column, height: Column) -> list[Column]:
    """Sort keys: most visible first, then nearest to the centre, then top and left."""
    return [F.desc(visible_area(b, width, height)), F.asc(centre_distance(b, width, height)), F.asc(b[1]), F.asc(b[0])]


def is_preview_pane(b: Box, width: Column) -> Column:
    return (b[0] > width * PREVIEW_SHARE) & (F.least(_span(b[0], b[2]), _span(b[1], b[3])) > PREVIEW_EDGE)


def suppress_duplicate(host: Box, badge: Box, url: Column, other_host: Box, other_badge: Box, other_url: Column) -> Column:
    """Two labels on one visual: same URL, or labels that touch."""
    return (smaller_overlap(host, other_host) >= OVERLAP) & ((url == other_url) | (smaller_overlap(badge, other_badge) > 0))


def suppress_pending(host: Box, badge: Box, other_host: Box, other_badge: Box, phase: Column) -> Column:
    return phase.isin("scored", "no-model") & (smaller_overlap(badge, other_badge) > 0) & (smaller_overlap(host, other_host) >= OVERLAP)


def occludes(host: Box, other: Box, margin: int = MARGIN) -> Column:
    """A layer of the page reaches out of the host's box, so it is not part of it."""
    return (other[0] < host[0] - margin) | (other[1] < host[1] - margin) | (other[2] > host[2] + margin) | (other[3] > host[3] + margin)


def hidden_by(topmost: Column, position: Column, layer: Column) -> Column:
    return ~topmost & (position.isin("fixed", "sticky") | layer)


def same_visual_overlay(host: Box, overlay: Box, position: Column, host_steps: Column, overlay_steps: Column) -> Column:
    """An overlay near in the tree that covers nearly all of the larger of both boxes."""
    near = ~position.isin("fixed", "sticky") & (host_steps <= 4) & (overlay_steps <= 2)
    share = common_area(host, overlay) / F.nullif(F.greatest(area(host), area(overlay)), F.lit(0.0))
    return near & (area(host) > 0) & (area(overlay) > 0) & F.coalesce(share >= SAME_VISUAL, F.lit(False))


def fitted(b: Box, width: Column, height: Column, fit: Column, x_share: Column, y_share: Column) -> Column:
    """Struct of the rectangle an image paints in its box; free space is dealt by shares of 0 to 1."""
    w, h = b[2] - b[0], b[3] - b[1]
    contain = F.least(w / F.nullif(width, F.lit(0.0)), h / F.nullif(height, F.lit(0.0)))
    scale = F.when(fit == "contain", contain).when(fit == "none", F.lit(1.0)).when(fit == "scale-down", F.least(F.lit(1.0), contain))
    pw, ph = F.coalesce(width * scale, w), F.coalesce(height * scale, h)
    left, top = b[0] + (w - pw) * x_share, b[1] + (h - ph) * y_share
    return F.struct(F.greatest(b[0], left).alias("left"), F.greatest(b[1], top).alias("top"), F.least(b[2], left + pw).alias("right"), F.least(b[3], top + ph).alias("bottom"))


def anchor(b: Box, clip: Box, inset: float, least: float = 0.0) -> Column:
    """Struct (x, y, visible) of a label inset from the visible corner, never past the far edge."""
    left, top, right, bottom = F.greatest(b[0], clip[0]), F.greatest(b[1], clip[1]), F.least(b[2], clip[2]), F.least(b[3], clip[3])
    seen = (right - left > least) & (bottom - top > least)
    return F.struct(F.when(seen, F.least(left + inset, right)).otherwise(0.0).alias("x"), F.when(seen, F.least(top + inset, bottom)).otherwise(0.0).alias("y"), seen.alias("visible"))


def is_watched(tag: Column) -> Column:
    from scoreloom.functions.texts import UNWATCHED

    return ~tag.isin(*UNWATCHED)
