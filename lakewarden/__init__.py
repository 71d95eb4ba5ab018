"""Lakewarden: a governed analytics layer on Spark."""

__version__ = "0.1.0"
