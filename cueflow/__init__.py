"""Subtitle and transcript correction, checking and learning as Spark DataFrame jobs."""

__version__ = "0.1.0"
