"""Sketch-telemetry analytics for mobile user-plane traffic, written as Spark jobs."""

__version__ = "0.1.0"
