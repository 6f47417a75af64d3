"""Residual boxes of an image difference: which are explained by known changes, and which of the rest are reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..limits import EMITTED_RESIDUALS, EXPLAINED_OVERLAP, MOST_RESIDUALS, PEER_IOU
from .folds import ddl, fold

BOX = ("x0", "y0", "x1", "y1")


def unexplained(residuals: DataFrame, explained: DataFrame, key: list[str], most: float = EXPLAINED_OVERLAP) -> DataFrame:
    """Residual boxes of which no box of explained, on the same page, covers more than most of the smaller one."""
    named = explained.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(c).alias(f"e_{c}") for c in BOX])
    page = [F.col(k) == F.col(f"_{k}") for k in key]
    covers = geometry.containment(geometry.box(), geometry.box("e_")) > most
    return residuals.join(named, [*page, covers], "left_anti")


def reported(residuals: DataFrame, key: list[str]) -> DataFrame:
    """The largest residuals of a page that don't overlap a larger one of their type, with suppressed_peers on the first.

    residuals: (key, change_type, area, box). What is kept depends on what was kept before; a page's fold stops
    at a bounded number.
    """

    def largest_first(rows: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for row in rows:
            if any(k["change_type"] == row["change_type"] and _iou(k, row) > PEER_IOU for k in kept):
                continue
            kept.append(row)
            if len(kept) >= MOST_RESIDUALS:
                break
        peers = max(0, len(kept) - EMITTED_RESIDUALS)
        return [row | {"suppressed_peers": 0 if k else peers} for k, row in enumerate(kept[:EMITTED_RESIDUALS])]

    wanted = residuals.select(*key, "change_type", "area", *BOX)
    return fold(wanted, key, [F.desc("area"), *BOX, "change_type"], ddl(wanted, "suppressed_peers int"), largest_first)


def _iou(a: dict, b: dict) -> float:
    w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    if w <= 0 or h <= 0:
        return 0.0
    size = lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
    return w * h / max(1e-9, size(a) + size(b) - w * h)
