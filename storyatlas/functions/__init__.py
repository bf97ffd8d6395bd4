"""Scalar rules as Spark columns."""
