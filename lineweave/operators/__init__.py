"""Operators over transition networks: ``f(df, *, params) -> DataFrame``, lazy, keyed by ``net``."""
