"""Column-expression helpers shared by all operators."""

from vigil.functions.columns import (
    clip,
    flag,
    full_frame,
    gated,
    nan_to_null,
    row_mean,
    safe_div,
    series_window,
    spread,
)

__all__ = [
    "clip",
    "flag",
    "full_frame",
    "gated",
    "nan_to_null",
    "row_mean",
    "safe_div",
    "series_window",
    "spread",
]
