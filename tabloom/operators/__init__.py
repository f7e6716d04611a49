"""Operators: each is ``f(DataFrame, ...) -> DataFrame``."""
