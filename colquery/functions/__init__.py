"""Scalar semantics of 32-bit integers."""

from .int4 import int_div, int_mod, int_neg, murmur32

__all__ = ["int_div", "int_mod", "int_neg", "murmur32"]
