"""Order-dependent work on small groups: merging a palette (at most 80 colours for each image) into fewer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def _near(colors: list[list[float]], tolerance: int) -> list[list[float]]:
    """Folds each colour, in order, into the first kept one within the tolerance, weighted by counts."""
    kept: list[list[float]] = []
    for r, g, b, n in colors:
        into = next((k for k in kept if sum((p - q) ** 2 for p, q in zip(k, (r, g, b), strict=False)) < tolerance**2), None)
        if into is None:
            kept.append([r, g, b, n])
        else:
            total = into[3] + n
            into[:] = [*((p * into[3] + q * n) / total for p, q in zip(into, (r, g, b), strict=False)), total]
    return kept


def _fewer(colors: list[list[float]], target: int) -> list[list[float]]:
    """Joins the closest pair, weighted by counts, until `target` colours are left."""
    while len(colors) > target:
        pairs = ((sum((p - q) ** 2 for p, q in zip(colors[i][:3], colors[j][:3], strict=True)), i, j) for i in range(len(colors)) for j in range(i))
        _, i, j = min(pairs)
        total = colors[i][3] + colors[j][3]
        colors[j] = [*((p * colors[i][3] + q * colors[j][3]) / total for p, q in zip(colors[i][:3], colors[j][:3], strict=True)), total]
        del colors[i]
    return colors


def agglomerated(palette: DataFrame, tolerance: int = 24, target: int = 8) -> DataFrame:
    """(image_id, idx, r, g, b, cnt): the palette (image_id, idx, r, g, b, cnt), near colours folded, then merged to the target."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        colors = pdf.sort_values("idx")[["r", "g", "b", "cnt"]].astype(float).values.tolist()
        found = sorted(_fewer(_near(colors, tolerance), target), key=lambda c: (-c[3], c[:3]))
        rows = [(pdf["image_id"].iloc[0], i, *(int(v + 0.5) for v in c[:3]), int(c[3])) for i, c in enumerate(found)]
        return pd.DataFrame(rows, columns=["image_id", "idx", "r", "g", "b", "cnt"])

    return palette.groupBy("image_id").applyInPandas(merge, "image_id long, idx int, r int, g int, b int, cnt long")
