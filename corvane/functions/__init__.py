"""Scalar and per-text functions."""
