"""LCS length with built-in functions only: an independent check of the kernel."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_native(a: str, b: str) -> Column:
    """LCS length with built-in functions only, for strings of at most 61 characters.

    Slower than the kernel.
    """
    full = "shiftleft(1L, 61) - 1L"
    mask = (
        f"aggregate(sequence(1, length({a})), 0L, (m, i) -> "
        f"IF(substr({a}, i, 1) = c, m | shiftleft(1L, i - 1), m))"
    )
    step = f"(((s + (s & {mask})) | (s - (s & {mask}))) & ({full}))"
    chars = f"array_remove(split({b}, ''), '')"
    end = f"aggregate({chars}, {full}, (s, c) -> {step})"
    return F.expr(f"IF({a} = '' OR {b} = '', 0, CAST(61 - bit_count({end}) AS INT))")
