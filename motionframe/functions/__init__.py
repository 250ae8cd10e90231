"""Scalar functions as SQL expressions."""
