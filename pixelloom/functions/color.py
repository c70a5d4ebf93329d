"""Colour arithmetic as column expressions. Channels are integers 0..255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp, clamp_byte, half_up, ratio, store_byte

#: Matte presets (below: 0, from: 255, smooth in between or passed).
MATTES = {"soft": (13, 217, False), "medium": (20, 150, True), "crisp": (35, 110, True)}
HALO_FACTORS = {"normal": 1.0, "gentle": 0.34}
NAMED_COLORS = {
    "black": "#000000",
    "white": "#ffffff",
    "red": "#ff0000",
    "lime": "#00ff00",
    "green": "#008000",
    "blue": "#0000ff",
    "yellow": "#ffff00",
    "gray": "#808080",
    "grey": "#808080",
}


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def distance2(a: list[Column], b: list) -> Column:
    d = [x - y for x, y in zip(a, b, strict=True)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def bucket_key(bits: int, r: Column, g: Column, b: Column) -> Column:
    """Channels cut to their upper bits, in one integer."""
    shift = 8 - bits
    part = [F.shiftright(c, shift) for c in (r, g, b)]
    return part[0] * (1 << 2 * bits) + part[1] * (1 << bits) + part[2]


def exact_key(r: Column, g: Column, b: Column) -> Column:
    return r * 65536 + g * 256 + b


def bin_24(r: Column, g: Column, b: Column) -> Column:
    """Number of a colour's bin in a histogram of 24 x 24 x 24."""
    part = [F.shiftright(c * 24, 8) for c in (r, g, b)]
    return part[0] * 576 + part[1] * 24 + part[2]


def matte(alpha: Column, low: int, high: int, smooth: bool) -> Column:
    t = (alpha - low) / F.lit(float(high - low))
    between = half_up(t * t * (F.lit(3.0) - 2 * t) * 255) if smooth else alpha
    return F.when(alpha <= low, 0).when(alpha >= high, 255).otherwise(between)


def halo_bounds(tolerance: float, softness: float, mode: str) -> tuple[int, int]:
    low = int(tolerance / 100 * 255 * HALO_FACTORS[mode] + 0.5)
    return low, min(255, low + max(1, int(softness / 100 * 64 + 0.5)))


def halo_alpha(alpha: Column, low: int, high: int) -> Column:
    """Faint alpha goes, alpha from `high` on stays, a ramp lies between."""
    t = (alpha - low) / F.lit(float(high - low))
    return F.when(alpha <= low, 0).when(alpha < high, half_up(alpha * t)).otherwise(alpha)


def levels(v: Column, black: int, white: int, gamma: float) -> Column:
    t = clamp((v - black) / F.lit(float(max(1, white - black))), 0.0, 1.0)
    return store_byte(F.pow(t, F.lit(1 / max(0.01, gamma))) * 255)


def shifted(v: Column, k: float, alpha: Column) -> Column:
    """Temperature: a channel moved by k where the pixel is visible."""
    return F.when(alpha == 0, v).otherwise(store_byte(v + F.lit(float(k))))


def over(v: Column, alpha: Column, background: int) -> Column:
    """A channel laid on a solid colour."""
    t = alpha / F.lit(255.0)
    return half_up(v * t + F.lit(float(background)) * (1 - t))


def key_alpha(distance: Column, solid: float, cut: float) -> Column:
    """Colour key: 0 up to `solid`, rising to 1 at `cut`."""
    return F.when(distance <= solid, F.lit(0.0)).otherwise((distance - solid) / F.lit(cut - solid))


def despilled(v: Column, alpha: Column, background: Column) -> Column:
    """The foreground that, mixed with the background at alpha, gave v."""
    return F.when(alpha > 0.02, clamp_byte((v - (1 - alpha) * background) / alpha)).otherwise(v)


def hsl(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue, saturation and lightness, each 0..1."""
    r, g, b = (c / F.lit(255.0) for c in (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span, light = high - low, (high + low) / 2
    grey = span == 0
    saturation = F.when(grey, 0.0).when(light > 0.5, ratio(span, 2 - high - low)).otherwise(ratio(span, high + low))
    sector = F.when(high == r, ratio(g - b, span) + F.when(g < b, 6.0).otherwise(0.0)).when(high == g, ratio(b - r, span) + 2).otherwise(ratio(r - g, span) + 4)
    return [F.when(grey, 0.0).otherwise(sector / 6), saturation, light]


def rgb(h: Column, s: Column, light: Column) -> list[Column]:
    """Channels 0..255 of hue, saturation and lightness."""
    q = F.when(light < 0.5, light * (1 + s)).otherwise(light + s - light * s)
    p = 2 * light - q

    def channel(t: Column) -> Column:
        t = t - F.floor(t)
        ramp = F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, p + (q - p) * (F.lit(2 / 3) - t) * 6).otherwise(p)
        return half_up(F.when(s == 0, light).otherwise(ramp) * 255)

    return [channel(h + F.lit(1 / 3)), channel(h), channel(h - F.lit(1 / 3))]


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(clamp(c, 0, 255)), 2, "0")) for c in (r, g, b)))


def channels_of_hex(text: Column) -> list[Column]:
    """Channels of #rrggbb; short digits are filled up with zeros, what is no hex digit counts as 0."""
    digits = F.rpad(F.regexp_replace(text, "^#", ""), 6, "0")
    part = lambda i: F.substring(digits, i, 2)
    return [F.when(part(i).rlike("^[0-9a-fA-F]{2}$"), F.conv(part(i), 16, 10).cast("int")).otherwise(0) for i in (1, 3, 5)]


def css_color(text: Column) -> Column:
    """#rrggbb of a CSS colour (#rrggbb, #rgb, rgb(), rgba(), a few names); null if it is none, or none/transparent."""
    s = F.lower(F.trim(text))
    d = [F.substring(s, i, 1) for i in (2, 3, 4)]
    number = r"^rgba?\(\s*([\d.]+)[,\s]+([\d.]+)[,\s]+([\d.]+)"
    parts = [F.regexp_extract(s, number, i).try_cast("double") for i in (1, 2, 3)]
    named = F.create_map(*(F.lit(x) for pair in NAMED_COLORS.items() for x in pair))
    return (
        F.when(s.rlike("^#[0-9a-f]{6}$"), s)
        .when(s.rlike("^#[0-9a-f]{3}$"), F.concat(F.lit("#"), d[0], d[0], d[1], d[1], d[2], d[2]))
        .when(s.rlike(number), hex_of(*(clamp_byte(p) for p in parts)))
        .otherwise(F.try_element_at(named, s))
    )
