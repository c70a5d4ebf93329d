"""Text, geometry and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain forms, for slugs.
MARKED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"


def output_name(path: Column, suffix: str, extension: str) -> Column:
    """dir/base.ext -> dir/base.suffix.extension"""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(f".{suffix}.{extension}"))


def swapped_extension(path: Column, extension: str) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", f".{extension}")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def slug(text: Column) -> Column:
    plain = F.lower(F.translate(text, MARKED, PLAIN))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9_]+", "-"), "^-+|-+$", "")


def version_numbers(text: Column) -> Column:
    """Up to three numbers of a version, missing ones 0."""
    parts = F.split(F.regexp_replace(text, "^v", ""), r"\.")
    return F.array(*(F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0)) for i in (1, 2, 3)))


def numbers(text: Column) -> Column:
    """The numbers of a comma-separated list; null where one is none."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))


def svg_size(svg: Column) -> tuple[Column, Column]:
    """Width and height: of the attributes, else of the viewBox, else 1024."""
    attribute = lambda name: F.regexp_extract(svg, rf'(?s)<svg[^>]*\s{name}="([\d.]+)', 1).try_cast("double")
    box = F.split(F.regexp_extract(svg, r'(?s)<svg[^>]*\sviewBox="([^"]*)"', 1), r"[\s,]+")
    return tuple(F.coalesce(attribute(n), F.try_element_at(box, F.lit(i)).try_cast("double"), F.lit(1024.0)) for n, i in (("width", 3), ("height", 4)))


def fill_of(element: Column) -> Column:
    """The fill attribute of an element, else the fill of its style; null if there is none."""
    attribute = F.regexp_extract(element, r'(?i)\bfill\s*=\s*"([^"]*)"', 1)
    style = F.regexp_extract(element, r'(?i)style\s*=\s*"[^"]*?\bfill\s*:\s*([^;"\']+)', 1)
    return F.coalesce(F.nullif(attribute, F.lit("")), F.nullif(style, F.lit("")))


def without_fill(element: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(element, r'(?i)\s*\bfill\s*=\s*"[^"]*"', ""), r"(?i)\bfill\s*:\s*[^;\"'}]+;?", "")


def content_key(content: Column) -> Column:
    """A short key of a content: 16 hex digits of its MD5."""
    return F.substring(F.md5(content), 1, 16)


def grid_points(per_side: int) -> Column:
    """Cell centres of a unit square cut into per_side x per_side cells, row by row."""
    axis = F.sequence(F.lit(0), F.lit(per_side - 1))
    centre = lambda i: (i + F.lit(0.5)) / per_side
    return F.flatten(F.transform(axis, lambda y: F.transform(axis, lambda x: F.struct(centre(x).alias("px"), centre(y).alias("py")))))


def crop_boxes(width: Column, height: Column, layers: int) -> Column:
    """The whole image, then for each layer a grid of overlapping crops: an array of (layer, x0, y0, x1, y1)."""
    whole = F.array(F.struct(F.lit(0).alias("layer"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), width.cast("int").alias("x1"), height.cast("int").alias("y1")))
    overlap = F.floor(F.lit(512 / 1500) * F.least(width, height)).cast("int")
    found = [whole]
    for layer in range(1, layers + 1):
        n = 2**layer
        wide, high = (F.ceil((overlap * (n - 1) + v) / n).cast("int") for v in (width, height))
        found.append(_crops(layer, n, wide, high, overlap, width.cast("int"), height.cast("int")))
    return F.concat(*found)


def _crops(layer: int, n: int, wide: Column, high: Column, overlap: Column, width: Column, height: Column) -> Column:
    def crop(x: Column, y: Column) -> Column:
        x0, y0 = (wide - overlap) * x, (high - overlap) * y
        x1, y1 = F.least(width, x0 + wide), F.least(height, y0 + high)
        return F.struct(F.lit(layer).alias("layer"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    axis = F.sequence(F.lit(0), F.lit(n - 1))
    return F.flatten(F.transform(axis, lambda y: F.transform(axis, lambda x: crop(x, y))))


def range_split(total: Column, parts: int) -> Column:
    """Contiguous ranges [start, end) of 0..total in `parts` parts: an array of (part, start, end)."""
    at = lambda i: F.floor(i * total / parts).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("part"), at(i).alias("start"), at(i + 1).alias("end")))


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a time without zone, the same in every session."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
