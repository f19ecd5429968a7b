"""Numbers as text for tables and annotations."""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd

from .types import vectorized


def area_text(area: float) -> str:
    """Three figures up to 100 (0.346, 3.46, 34.6), whole numbers with a comma at the thousands beyond."""
    if area > 100:
        return format(round(area), ",")
    return format(Decimal(f"{area:.2e}").normalize(), "f")


def scientific(x: float, figures: int, always: bool = False) -> str:
    """A whole number where its figures end before the point, else a power of ten in TeX, with so many figures behind the point."""
    number, power = f"{x:.{figures}e}".split("e")
    if int(power) >= figures and not always:
        return format(Decimal(number).scaleb(int(power)), ".0f")
    return rf"${number} \times 10^{{{int(power)}}}$"


@vectorized("string")
def format_area(area: pd.Series) -> pd.Series:
    return area.map(lambda a: None if a is None or a != a else area_text(float(a)))


def plain_number(text: str) -> float:
    """The inverse of both, to the figures shown."""
    m = re.match(r"^\$([\d.]+) .times 10\^\{(-?\d+)\}\$$", text)
    return float(m[1]) * 10.0 ** int(m[2]) if m else float(text.replace(",", ""))
