"""Spectral indices and masks of satellite bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.functions.numeric import clip

# Constants of the indices (wavelengths in nm) and of the stored reflectances.
EPS = 1e-6
CRSWIR = (1610 - 842) / (2190 - 842)
REFLECTANCE_SCALE = 65535 / 3000
CLOUD_BIT, CIRRUS_BIT, CLOUD_CLASSES = 1 << 10, 1 << 11, (3, 8, 9, 10, 11)


def reflectance(stored: Column) -> Column:
    return stored.cast("double") / REFLECTANCE_SCALE


def ndvi(b8: Column, b4: Column) -> Column:
    return clip((b8 - b4) / (b8 + b4 + EPS), -1, 1)


def evi(b8: Column, b4: Column, b2: Column) -> Column:
    return clip(2.5 * (b8 - b4) / (b8 + 6.0 * b4 - 7.5 * b2 + 1.0 + EPS), -1, 1)


def nbr(b8: Column, b12: Column) -> Column:
    return clip((b8 - b12) / (b8 + b12 + EPS), -1, 1)


def crswir(b8: Column, b11: Column, b12: Column) -> Column:
    return clip(b11 / ((b12 - b8) * CRSWIR + b8 + EPS), 0, 5)


def all_indices(b2: Column, b4: Column, b8: Column, b11: Column, b12: Column) -> dict[str, Column]:
    return {"ndvi": ndvi(b8, b4), "evi": evi(b8, b4, b2), "nbr": nbr(b8, b12), "crswir": crswir(b8, b11, b12)}


def cloud_weight(percent: Column) -> Column:
    return clip(1 - percent / 100, 0, 1)


def cloud_free(qa: Column, scene_class: Column) -> Column:
    """Neither the cloud nor the cirrus bit, and no cloud or shadow class."""
    return (qa.bitwiseAND(CLOUD_BIT) == 0) & (qa.bitwiseAND(CIRRUS_BIT) == 0) & ~scene_class.isin(*CLOUD_CLASSES)


def forest_class(mask: Column, probability: Column, threshold: int = 128, nodata: int = 255) -> Column:
    """1 or 2 inside the mask by the threshold, else 0."""
    return F.when((mask == 1) & (probability != nodata), F.when(probability >= threshold, 1).otherwise(2)).otherwise(0)


def masked_class(value: Column, mask: Column, nodata: int = 255) -> Column:
    return F.when((mask > 0) & (mask != nodata), value).otherwise(0)


def soft_labels(mask: Column, probability: Column, scale: float = 255.0, nodata: int = 255) -> dict[str, Column]:
    """Bytes for no forest, deciduous and evergreen of a hard mask; probability without data counts as half."""
    p = F.when(probability == nodata, 0.5).otherwise(clip(probability / scale, 0, 1))
    forest = F.when(mask == 1, 1.0).otherwise(0.0)
    return {"p_nonforest": F.bround((1 - forest) * 255, 0).cast("int"), "p_deciduous": F.bround(forest * p * 255, 0).cast("int"), "p_evergreen": F.bround(forest * (1 - p) * 255, 0).cast("int")}
