"""Plans: options, the default steps, and a whole batch of images in one plan. Steps are DataFrame -> DataFrame functions on
pixels; what depends on an image's content is computed first and becomes a column, so all images share one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import MATTES, halo_alpha, halo_bounds, matte, over
from ..functions.numeric import clamp, half_up
from ..operators.aggregates import border_median, border_uniformity, bounding_box, color_cardinality
from ..operators.reach import keyed_out
from ..operators.resample import shrunken
from ..operators.windows import IMAGE, by_image, defringed, defringed_by, dilated_one, eroded_alpha, guided_alpha, snapped_alpha, sobel, tasks_of
from .shared import stored

#: The order of the default plan.
DEFAULT_STEPS = ("analyze", "upscale-input", "remove-bg", "clean-halo", "fix-color", "auto-crop", "bg-fill", "fix-dpi", "export")
#: Names of the profiles, and what each of them decides.
PROFILE_MATTES = {"logo": "crisp", "ilustracion": "medium", "producto": "medium", "foto": "soft"}
PROFILE_DEFRINGE = {"logo": 0, "ilustracion": 1, "producto": 1, "foto": 2}
GENTLE = ("foto",)  # profiles whose faint edges are mostly kept
EXPANDED = ("logo", "ilustracion")  # profiles whose edge grows by a pixel
KEYED, FLAT = ("logo", "ilustracion"), 0.62  # profiles whose flat ground is taken out by its colour, and how flat it must be


@dataclass(frozen=True)
class Options:
    profile: str | None = None  # None, here and below: by the image's content
    matte: str | None = None
    halo_mode: str | None = None
    tolerance: float = 10
    softness: float = 10
    hard_edge: bool = False
    expand_edge: bool = True
    contract: int = 0
    background: tuple[int, int, int] | None = None
    steps: Sequence[str] = field(default_factory=lambda: DEFAULT_STEPS)


def profile(unique_colors: Column, edge_density: Column, uniformity: Column) -> Column:
    """Kind of an image: a flat border means a graphic (few colours: a logo), a fairly flat one with many colours and little
    texture a product, anything else a photo."""
    return (
        F.when((uniformity >= 0.7) & (unique_colors <= 90), "logo")
        .when(uniformity >= 0.7, "ilustracion")
        .when((uniformity >= 0.45) & (unique_colors >= 1500) & (edge_density < 0.16), "producto")
        .otherwise("foto")
    )


def features(px: DataFrame) -> DataFrame:
    """(image_id, unique_colors, edge_density, uniformity, profile), as an image of ANALYSIS_SIDE pixels at most shows them. Each feature
    is written, one row for each image, so that a task holds what one of them needs."""
    tasks = tasks_of(px)
    px = by_image(stored(shrunken(by_image(px, tasks)), "shrunken"), tasks)  # read by each of the features, which would shrink anew otherwise
    edges = stored(sobel(px).groupBy(IMAGE).agg((F.count_if(F.col("magnitude") > 48) / F.count(F.lit(1))).alias("edge_density")), "edges")
    colors, borders = stored(color_cardinality(px), "colors"), stored(border_uniformity(px), "borders")
    found = px.select(IMAGE).distinct().join(colors, IMAGE, "left").join(edges, IMAGE, "left").join(borders, IMAGE, "left")
    found = found.withColumns({"unique_colors": F.coalesce("unique_colors", F.lit(0).cast("long")), "edge_density": F.coalesce("edge_density", F.lit(0.0))})
    return found.withColumn("profile", profile(F.col("unique_colors"), F.col("edge_density"), F.col("uniformity")))


def routed(px: DataFrame, options: Options) -> DataFrame:
    """(image_id, profile, flat): what decides an image's way through the steps, one row for each image."""
    flat = stored(border_uniformity(by_image(px, tasks_of(px))).select(IMAGE, (F.col("uniformity") > FLAT).alias("_flat")), "flat")  # at full size, unlike the profile
    kinds = features(px).select(IMAGE, "profile").join(flat, IMAGE, "left").select(IMAGE, "profile", F.coalesce("_flat", F.lit(False)).alias("flat"))
    return stored(kinds.withColumn("profile", F.lit(options.profile)) if options.profile else kinds, "routed")


def remove_background(px: DataFrame, options: Options, kinds: DataFrame) -> DataFrame:
    """Each image by its own way: graphics on a flat ground lose the ground's colour from the border on; of all others the given alpha
    is a matte, which is aligned to the image's edges where the profile wants it soft, cleaned of the ground's tint, and drawn
    through the profile's curve (or the one of the options). The ways are two branches of one plan."""
    names = px.columns
    keyed, tasks = F.col("profile").isin(*KEYED) & F.col("flat"), tasks_of(px)
    px = stored(by_image(px, tasks).join(by_image(kinds.select(IMAGE, "profile", keyed.alias("_flat")), tasks), IMAGE), "profiled")
    flat, rest = by_image(px.where("_flat").select(names), tasks), px.where("NOT _flat")

    cut = 90 + options.tolerance / 100 * 150
    ramp = 2 if options.hard_edge else 10 + options.softness / 100 * 22
    keyed = keyed_out(flat, by_image(stored(border_median(flat), "ground"), tasks), max(6.0, cut - ramp), cut, tasks)
    keyed = eroded_alpha(by_image(defringed(keyed, 4, tasks), tasks), 1)

    wanted = F.lit(options.matte) if options.matte else F.element_at(F.create_map(*(F.lit(v) for pair in PROFILE_MATTES.items() for v in pair)), F.col("profile"))
    passes = F.element_at(F.create_map(*(F.lit(v) for pair in PROFILE_DEFRINGE.items() for v in pair)), F.col("profile"))
    rest = rest.withColumns({"_matte": wanted, "_passes": F.coalesce(passes, F.lit(0))})
    keep = ["r", "g", "b", "_matte", "_passes", *(c for c in names if c not in (IMAGE, *"xyrgba"))]
    soft = guided_alpha(rest.where("_matte = 'soft'"), keep=keep, tasks=tasks).withColumn("a", clamp(half_up(F.col("alpha")), 0, 255).cast("int")).drop("alpha")
    soft = snapped_alpha(soft, keep=keep, tasks=tasks).withColumn("a", half_up(F.col("alpha") * 255).cast("int")).drop("alpha")
    rest = rest.where("_matte IS DISTINCT FROM 'soft'").select(*soft.columns).unionByName(soft)
    rest = defringed_by(rest, F.col("_passes"), max(PROFILE_DEFRINGE.values()), tasks)
    drawn = F.col("a")
    for name, bounds in MATTES.items():
        drawn = F.when(F.col("_matte") == name, matte(F.col("a"), *bounds)).otherwise(drawn)
    rest = defringed(rest.withColumn("a", drawn.cast("int")), 3, tasks)
    every = eroded_alpha(keyed.unionByName(rest.select(*names)), options.contract)
    if options.hard_edge:
        every = every.withColumn("a", F.when(F.col("a") >= 128, 255).otherwise(0))
    return stored(every, "removed")  # the steps that follow read it more than once


def clean_halo(px: DataFrame, options: Options, kinds: DataFrame) -> DataFrame:
    """Faint pixels go, by the profile's mode or the one of the options; then the edge of graphics grows by a pixel."""
    names, tasks = px.columns, tasks_of(px)
    px = by_image(px, tasks).join(by_image(kinds.select(IMAGE, F.col("profile").alias("_profile")), tasks), IMAGE)
    px = by_image(stored(px, "halo"), tasks)  # Spark may split a join in one branch below and not in the other, and then can't unite them
    cleaned = lambda mode: halo_alpha(F.col("a"), *halo_bounds(options.tolerance, options.softness, mode))
    if options.halo_mode is None:
        px = px.withColumn("a", F.when(F.col("_profile").isin(*GENTLE), cleaned("gentle")).otherwise(cleaned("normal")).cast("int"))
    elif options.halo_mode != "off":
        px = px.withColumn("a", cleaned(options.halo_mode).cast("int"))
    if not options.expand_edge:
        return px.select(*names)
    grown = dilated_one(px.where(F.col("_profile").isin(*EXPANDED)).select(*names)).select(*names)
    return stored(grown.unionByName(px.where(~F.col("_profile").isin(*EXPANDED)).select(*names)), "haloed")


def auto_crop(px: DataFrame, options: Options, kinds: DataFrame) -> DataFrame:
    """Cut to the box of visible pixels; images without any stay whole."""
    px = by_image(px, tasks_of(px))
    box = bounding_box(px).select(IMAGE, "x0", "y0", "x1", "y1")
    joined = px.join(box, IMAGE, "left")
    inside = F.col("x0").isNull() | (F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    shift = lambda c: (F.col(c) - F.coalesce(f"{c}0", F.lit(0))).alias(c)
    return joined.where(inside).select(IMAGE, shift("x"), shift("y"), "r", "g", "b", "a")


def fill_background(px: DataFrame, options: Options, kinds: DataFrame) -> DataFrame:
    if options.background is None:
        return px
    filled = {c: over(F.col(c), F.col("a"), v) for c, v in zip("rgb", options.background, strict=True)}
    return px.withColumns(filled).withColumn("a", F.lit(255))


STEPS: dict[str, Callable[[DataFrame, Options, DataFrame], DataFrame]] = {"remove-bg": remove_background, "clean-halo": clean_halo, "auto-crop": auto_crop, "bg-fill": fill_background}


def run_plan(px: DataFrame, options: Options) -> DataFrame:
    """px (image_id, x, y, r, g, b, a) through the options' steps, in their order; each image takes the way that its content, as
    given, decides. Steps that only concern codecs or metadata pass pixels on. Images have an id."""
    unknown = [name for name in options.steps if name not in DEFAULT_STEPS]
    if unknown:
        raise ValueError(f"no step {unknown[0]}")
    kinds = routed(px, options)
    for name in options.steps:
        if name in STEPS:
            px = STEPS[name](px, options, kinds)
    return px
