"""SVG drawings, text in and text out. A drawing is one row; its draw elements, with their bodies, are taken in document order, neighbours
of one colour become a named group whose fill they inherit, and everything else (gradients, definitions) is kept as it stands. All of it is
an expression on the row, so nothing shuffles and memory is that of one drawing. Edits of colours act on the groups of a drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import css_color
from ..functions.text import fill_of, without_fill

#: The elements that draw, and the marks of a group.
DRAWN = ("path", "polygon", "polyline", "circle", "ellipse", "rect")
GROUP_ID, GROUP_COLOR = "capa-", "data-color"

_ELEMENT = rf"(?is)<({'|'.join(DRAWN)})\b[^>]*?(?:/>|>.*?</\1>)"
_OPEN, _DEFS = r"(?is)<svg\b[^>]*>", r"(?is)<defs\b.*?</defs>"


def _found(text: Column, pattern: str) -> Column:
    """The first match, null if there is none."""
    return F.regexp_substr(text, F.lit(pattern))


def _inner(svg: Column) -> Column:
    """What stands between the svg tags; null if the text is no drawing."""
    start = F.instr(svg, _found(svg, _OPEN)) + F.char_length(_found(svg, _OPEN))
    end = F.char_length(svg) - F.instr(F.reverse(svg), F.lit("</svg>"[::-1])) - len("</svg>") + 2
    closed = F.instr(svg, F.lit("</svg>")) > 0
    return F.when(closed & (end >= start), F.substring(svg, start, end - start))


def elements(svg: Column) -> Column:
    """The draw elements of a drawing in their order, as an array of (color, element); color is null where it is no flat one."""
    found = F.regexp_extract_all(F.coalesce(_inner(svg), F.lit("")), F.lit(_ELEMENT), F.lit(0))
    return F.transform(found, lambda e: F.struct(css_color(fill_of(e)).alias("color"), e.alias("element")))


def grouped(docs: DataFrame, text: str = "svg") -> DataFrame:
    """docs plus `grouped`, the drawing with its elements in groups of neighbours of one colour, and `runs`, their number. A text that is no
    drawing, or draws nothing, stays as it is."""
    names = docs.columns
    whole = docs.withColumn("_e", elements(F.col(text)))
    color = lambda i: F.element_at("_e", i)["color"]
    fresh = lambda i: (i == 1) | ~color(i).eqNullSafe(F.when(i > 1, color(F.greatest(i - 1, F.lit(1)))))
    whole = whole.withColumn("_s", F.when(F.size("_e") > 0, F.filter(F.sequence(F.lit(1), F.greatest(F.size("_e"), F.lit(1))), fresh)).otherwise(F.array().cast("array<int>")))

    def group(start: Column, k: Column) -> Column:
        end = F.coalesce(F.try_element_at("_s", k + 2), F.size("_e") + 1)
        flat = color(start)
        parts = F.transform(F.slice("_e", start, end - start), lambda e: F.when(flat.isNull(), e["element"]).otherwise(without_fill(e["element"])))
        about = F.coalesce(F.concat(F.lit(f'" {GROUP_COLOR}="'), flat, F.lit('" fill="'), flat, F.lit('">')), F.lit('">'))
        return F.concat(F.lit(f'<g id="{GROUP_ID}'), (k + 1).cast("string"), about, F.array_join(parts, ""), F.lit("</g>"))

    body = F.array_join(F.transform("_s", group), "")
    out = F.concat(_found(F.col(text), _OPEN), F.coalesce(_found(_inner(F.col(text)), _DEFS), F.lit("")), body, F.lit("</svg>"))
    return whole.select(*names, F.when(F.size("_s") > 0, out).otherwise(F.col(text)).alias("grouped"), F.size("_s").alias("runs"))


def color_counts(docs: DataFrame, key: str = "doc_id", text: str = "svg") -> DataFrame:
    """(key, pos, color, n): the flat colours of each drawing by how many elements have them, the first seen first on a tie."""
    found = docs.select(key, F.posexplode(elements(F.col(text))).alias("at", "e")).where("e.color IS NOT NULL")
    counts = found.groupBy(key, F.col("e.color").alias("color")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # a drawing has as many colours as it has elements at most
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "color")))
    return counts.groupBy(key).agg(ranked.alias("all")).select(key, F.posexplode("all").alias("pos", "c")).select(key, "pos", "c.color", (-F.col("c.m")).alias("n"))


def edited(docs: DataFrame, edits: DataFrame, key: str = "doc_id", text: str = "grouped") -> DataFrame:
    """docs plus `edited`: the groups of a grouped drawing recoloured or removed. edits: (key, step, color, to, remove), in the order of their
    steps; a group that an edit has recoloured counts as of its new colour for those that follow."""
    names = docs.columns
    lists = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", "color", "to", "remove"))).alias("_edits"))
    joined = docs.join(lists, key, "left").withColumn("_edits", F.coalesce("_edits", F.array().cast(lists.schema["_edits"].dataType)))

    def last(color: Column) -> Column:
        """(gone, color) of a group after all edits."""
        start = F.struct(F.lit(False).alias("gone"), color.alias("color"))
        hit = lambda s, e: ~s["gone"] & s["color"].eqNullSafe(e["color"])
        step = lambda s, e: F.struct((s["gone"] | (hit(s, e) & F.coalesce(e["remove"], F.lit(False)))).alias("gone"), F.when(hit(s, e), F.coalesce(e["to"], s["color"])).otherwise(s["color"]).alias("color"))
        return F.aggregate("_edits", start, step)

    # each piece but the first begins with a group; behind its end stands what is no group of a colour
    pieces = F.split(F.col(text), rf'(?=<g id="{GROUP_ID}\d+" {GROUP_COLOR}=")')
    shape = rf'(?s)^(<g id="{GROUP_ID}\d+" {GROUP_COLOR}=")([^"]*)("[^>]*>)(.*?</g>)(.*)$'
    part = lambda p, i: F.regexp_extract(p, shape, i)

    def piece(p: Column) -> Column:
        old, after = part(p, 2), last(part(p, 2))
        laid = F.concat(part(p, 1), after["color"], F.replace(part(p, 3), F.concat(F.lit('fill="'), old, F.lit('"')), F.concat(F.lit('fill="'), after["color"], F.lit('"'))), part(p, 4))
        kept = F.when(after["gone"], F.lit("")).otherwise(laid)
        return F.when(p.rlike(shape), F.concat(kept, part(p, 5))).otherwise(p)

    return joined.select(*names, F.array_join(F.transform(pieces, piece), "").alias("edited"))
