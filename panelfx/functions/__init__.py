"""Scalar column functions and distribution helpers."""
