"""Spark jobs for battery-fleet telemetry tables."""
