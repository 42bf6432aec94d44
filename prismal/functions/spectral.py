"""Column expressions over spectra (arrays of doubles, one element a band)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Band centres in nm that the indices refer to.
TARGETS = {"blue": 480.0, "green": 560.0, "red": 660.0, "nir": 860.0, "swir1": 1650.0, "swir2": 2200.0}


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x * x)))


def l2_normalised(a: Column) -> Column:
    """The spectrum over its length; a zero spectrum stays zero."""
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n))), F.lit(0))


def spectral_angle(a: Column, b: Column) -> Column:
    """Angle in radians; NULL where a length is zero or a spectrum is missing."""
    cosine = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.acos(F.when(cosine.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))


def magnitude(a: Column, b: Column, order: int = 2) -> Column:
    """Length of b - a, by the L1 or L2 norm."""
    if order not in (1, 2):
        raise ValueError("order is 1 or 2")
    gap = F.zip_with(b, a, lambda x, y: x - y)
    return _fold(F.transform(gap, F.abs)) if order == 1 else norm(gap)


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); NULL where the sum is zero."""
    return F.try_divide(a - b, a + b)


class Bands:
    """The values of a spectrum by the names of TARGETS, given the band number of each."""

    def __init__(self, spectrum: Column, band_of: dict[str, int]) -> None:
        self._spectrum, self._band_of = spectrum, band_of

    def __getattr__(self, name: str) -> Column:
        return F.get(self._spectrum, F.lit(self._band_of[name]))


#: name -> formula over Bands, filled by the functions below.
INDICES: dict = {}


def _index(f):
    INDICES[f.__name__] = f
    return f


@_index
def ndbi(s: Bands) -> Column:
    return normalised_difference(s.swir1, s.nir)


@_index
def iron_oxide_ratio(s: Bands) -> Column:
    return F.try_divide(s.red, s.blue)


@_index
def clay_ratio(s: Bands) -> Column:
    return F.try_divide(s.swir1, s.swir2)


@_index
def brightness(s: Bands) -> Column:
    return (s.blue + s.green + s.red + s.nir) / 4


@_index
def ndvi(s: Bands) -> Column:
    return normalised_difference(s.nir, s.red)


@_index
def ndwi(s: Bands) -> Column:
    return normalised_difference(s.green, s.nir)


@_index
def nbr(s: Bands) -> Column:
    return normalised_difference(s.nir, s.swir2)


@_index
def bsi(s: Bands) -> Column:
    return normalised_difference(s.swir1 + s.red, s.nir + s.blue)


def index(name: str, spectrum: Column, band_of: dict[str, int]) -> Column:
    """An index of a spectrum, given the band number of each named colour."""
    return INDICES[name](Bands(spectrum, band_of))


def index_score(px: DataFrame, names: list[str], band_of: dict[str, int]) -> DataFrame:
    """scene_id, pix, index: the mean of several indices, each by rank; NULL where one of them is."""
    from prismal.operators import scoring
    from prismal.session import stored

    x = stored(px.select("scene_id", "pix", *(index(n, F.col("spectrum"), band_of).alias(n) for n in names)), "indices")
    return scoring._weighed(x, {n: 1 / len(names) for n in names}, "scene_id").select("scene_id", "pix", F.col("score").alias("index"))


def cloudy(spectrum: Column, band_of: dict[str, int], *, blue: float = 0.25, swir1: float = 0.20, ndvi_below: float = 0.20) -> Column:
    """Bright in blue, dark in the short-wave infrared, no plants; a missing band is no cloud."""
    s = Bands(spectrum, band_of)
    return F.coalesce((s.blue > blue) & (s.swir1 < swir1) & (ndvi(s) < ndvi_below), F.lit(False))


def rbf(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-gamma * _fold(F.transform(F.zip_with(a, b, lambda x, y: x - y), lambda d: d * d)))


def angle_encoded(value: Column, lo: Column, hi: Column) -> Column:
    """[lo, hi] onto [0, pi], clipped; an empty range counts as 1."""
    span = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    return F.lit(3.141592653589793) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - lo) / span))
