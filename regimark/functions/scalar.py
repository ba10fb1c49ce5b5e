"""Scalar expressions over columns: guards, probabilities, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Area of a pixel in mm^2, frames a second, names of regimes and of models.
PIXEL_MM2 = 0.000064
FRAME_RATE = 20000.0
REGIMES = {0: "low", 1: "nominal", 2: "high"}
FLOOR = 1e-12


def finite(x: Column) -> Column:
    """x as double, NULL where it is NaN, infinite or no number."""
    d = x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def rounded(x: Column, digits: int = 6) -> Column:
    """x rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def floored_log(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(FLOOR)))


def softmax(logits: list[Column]) -> list[Column]:
    """Probabilities of logits, shifted by their maximum; the sum is kept from zero."""
    top = F.greatest(*logits)
    powers = [F.exp(x - top) for x in logits]
    total = powers[0]
    for p in powers[1:]:
        total = total + p
    return [p / F.greatest(total, F.lit(FLOOR)) for p in powers]


def first_argmax(values: list[Column]) -> Column:
    """Place of the largest value, the first of equals."""
    every = F.array(*values)
    return (F.array_position(every, F.array_max(every)) - 1).cast("int")


def normalised_entropy(p: list[Column]) -> Column:
    """Entropy of a distribution over its largest possible."""
    total = F.lit(0.0)
    for x in p:
        total = total - F.greatest(x, F.lit(FLOOR)) * floored_log(x)
    return total / F.ln(F.lit(float(len(p))))


def min_max(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / F.greatest(high - low, F.lit(FLOOR))


def mm2_to_pixels(x: Column) -> Column:
    return x / F.lit(PIXEL_MM2)


def frame_seconds(frame: Column) -> Column:
    return frame / F.lit(FRAME_RATE)


def named(code: Column, names: dict) -> Column:
    """names[code], else the code itself as text."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), code.cast("string"))


def part_number(video: Column) -> Column:
    """The number at the end of an id like `..._P12`; NULL without one."""
    return F.regexp_extract(video, r"P(\d+)$", 1).try_cast("int")


def method_threshold(method: Column) -> Column:
    """The threshold in a method's name like `..._0.30`; NULL without one."""
    return F.regexp_extract(method, r"(\d+\.\d+)", 1).try_cast("double")


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def file_class(name: Column) -> Column:
    """What a member of an archive is. Measured results are told by their prefix before other names."""
    low = F.lower(name)
    return (
        F.when(low.rlike(r"daq_rhf_p\d+_layer\d+\.csv$"), "encoder_feedback")
        .when(F.contains(low, F.lit("daq_rhf_")), "analysis_results")
        .when(low.rlike(r"(^|/)daq_p\d+"), "encoder_feedback")
        .when(low.rlike(r"(^|/)rhf_p\d+"), "command")
        .otherwise("other_csv")
    )


def divided(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or NULL."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
