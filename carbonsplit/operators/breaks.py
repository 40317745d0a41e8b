"""Break points of a diverging scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Positions between zero and the bound on either side.
LOW_STEPS = (1.0, 2.0 / 3.0, 1.0 / 3.0)
HIGH_STEPS = (1.0 / 3.0, 2.0 / 3.0, 1.0)


def diverging_breaks(
    df: DataFrame,
    column: str,
    scale: float = 1.0,
    method: str = "linear",
    lo: float | None = None,
    hi: float | None = None,
) -> DataFrame:
    """Seven breaks from the minimum over zero to the maximum: ``(position, break)``.

    Bounds are those of the data unless given.  ``method='asinh'`` spaces the
    breaks evenly on the inverse-hyperbolic-sine scale.
    """
    if method not in ("linear", "asinh"):
        raise ValueError(f"unknown method {method!r}")
    curve, back = (F.asinh, F.sinh) if method == "asinh" else (lambda c: c, lambda c: c)
    value = F.col(column) / F.lit(float(scale))
    bounds = df.agg(
        (F.min(value) if lo is None else F.max(F.lit(float(lo)))).alias("_lo"),
        (F.max(value) if hi is None else F.max(F.lit(float(hi)))).alias("_hi"),
    )
    low, high = curve(F.col("_lo")), curve(F.col("_hi"))
    steps = [
        *[back(low * F.lit(s)) for s in LOW_STEPS],
        F.lit(0.0),
        *[back(high * F.lit(s)) for s in HIGH_STEPS],
    ]
    return bounds.select(F.posexplode(F.array(*steps)).alias("position", "break"))
