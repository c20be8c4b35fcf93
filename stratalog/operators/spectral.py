"""Spectral images: XOR deltas, planes and pixels, integration over wavelengths, film curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The linear sRGB matrix for the D65 white point.
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))

#: Colour matching functions of the 1931 observer as sums of skewed Gaussians (published fit): weight, centre, width below, width above.
MATCHING = {
    "x": ((1.056, 599.8, 37.9, 31.0), (0.362, 442.0, 16.0, 26.7), (-0.065, 501.1, 20.4, 26.2)),
    "y": ((0.821, 568.8, 46.9, 40.5), (0.286, 530.9, 16.3, 31.1)),
    "z": ((1.217, 437.0, 11.8, 36.0), (0.681, 459.0, 26.0, 13.8)),
}
VISIBLE = (380.0, 780.0)

Table = Sequence[tuple[float, float, float, float]]


def wavelength(band: Column, bands: int, low: float = 380.0, high: float = 780.0) -> Column:
    return F.lit(low) + band * ((high - low) / max(bands - 1, 1))


def matching(which: str, at: Column, table: Table | None = None) -> Column:
    """Colour matching function x, y or z at a wavelength in nm; 0 outside the visible range.

    From a table (rows of wavelength, x, y, z at even steps) it is interpolated, as from the published
    one of 5 nm; without a table it is the published fit.
    """
    if table is not None:
        low, step, last = table[0][0], table[1][0] - table[0][0], len(table) - 1
        values = F.array(*[F.lit(float(row["xyz".index(which) + 1])) for row in table])
        place = (at - low) / step
        left = F.least(F.floor(place), F.lit(last - 1)).cast("int")
        a, b = F.get(values, left), F.get(values, left + 1)
        return F.when(at.between(low, table[-1][0]), a + (place - left) * (b - a)).otherwise(0.0)
    total = F.lit(0.0)
    for weight, centre, below, above in MATCHING[which]:
        t = (at - centre) / F.when(at < centre, below).otherwise(above)
        total = total + weight * F.exp(-0.5 * t * t)
    return F.when(at.between(*VISIBLE), total).otherwise(0.0)


def xor_encode(samples: DataFrame, row: list[str], order: str, value: str) -> DataFrame:
    """samples with delta: value XOR the value before in its row."""
    before = F.lag(value).over(Window.partitionBy(*row).orderBy(order))
    return samples.withColumn("delta", F.col(value).bitwiseXOR(F.coalesce(before, F.lit(0))))


def xor_decode(samples: DataFrame, row: list[str], order: str, delta: str = "delta") -> DataFrame:
    """samples with value: the XOR of all deltas up to it in its row."""
    upto = Window.partitionBy(*row).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("value", F.bit_xor(delta).over(upto))


def planes(pixels: DataFrame, id_column: str, bands: str) -> DataFrame:
    """A row for each band of each pixel."""
    return pixels.select(id_column, F.posexplode(bands).alias("band", "value"))


def pixels(long: DataFrame, id_column: str) -> DataFrame:
    """Pixels with their bands in order, from planes."""
    return long.groupBy(id_column).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "value"))), lambda x: x["value"]).alias("bands"))


def integrate(bands: Column, count: int, low: float = 380.0, high: float = 780.0, table: Table | None = None) -> list[Column]:
    """X, Y, Z of a pixel's bands, such that a flat spectrum of 1 has Y = 1; no explode, no shuffle."""
    at = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: wavelength(b, count, low, high))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    norm = total(F.transform(at, lambda w: matching("y", w, table)))
    part = lambda c: total(F.zip_with(bands, at, lambda v, w: v.cast("double") * matching(c, w, table))) / norm
    return [part(c).alias(c.upper()) for c in "xyz"]


def to_rgb(x: Column, y: Column, z: Column) -> list[Column]:
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return [clamp(a * x + b * y + c * z).alias(name) for name, (a, b, c) in zip("rgb", XYZ_TO_RGB, strict=True)]


def gamma_encoded(v: Column) -> Column:
    """The sRGB transfer curve."""
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def film_density(energy: Column, weight: Column, curve: dict[str, float]) -> Column:
    """Density of a developed sample: a toe, a straight part in the logarithm of the exposure, and a shoulder."""
    c = curve
    exposure = F.when(weight > 0, energy / weight).otherwise(c["base_fog"]) * c["iso"]
    straight = c["gamma"] * F.log10(F.greatest(exposure, F.lit(0.0)) + 1e-10)
    toe_end = c["gamma"] * F.log10(F.lit(c["toe_limit"] + 1e-10))
    toe = c["base_fog"] + exposure / c["toe_limit"] * (toe_end - c["base_fog"])
    share = F.least((exposure - c["shoulder_limit"]) / (2 * c["shoulder_limit"]), F.lit(1.0))
    shoulder = straight + (c["max_density"] - straight) * share
    return F.least(F.when(exposure <= c["toe_limit"], toe).when(exposure >= c["shoulder_limit"], shoulder).otherwise(straight), F.lit(c["max_density"]))


def develop(samples: DataFrame, id_column: str, bands: int, curve: dict[str, float], table: Table | None = None) -> DataFrame:
    """id, r, g, b of pixels from (id, band, energy, weight): densities to light, summed over wavelengths."""
    light = F.pow(F.lit(10.0), film_density(F.col("energy"), F.col("weight"), curve))
    at = wavelength(F.col("band"), bands)
    width = (VISIBLE[1] - VISIBLE[0]) / max(bands - 1, 1) / 300.0 if bands > 1 else 1.0
    sums = samples.groupBy(id_column).agg(*[F.sum(light * matching(c, at, table) * width).alias(c.upper()) for c in "xyz"])
    return sums.select(id_column, *to_rgb(F.col("X"), F.col("Y"), F.col("Z")))
