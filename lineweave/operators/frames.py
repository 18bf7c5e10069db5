"""Frames that kernels hand back."""

from __future__ import annotations

import pandas as pd


def empty(*names: str) -> pd.DataFrame:
    """No rows; columns of objects, which convert to any type."""
    return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
