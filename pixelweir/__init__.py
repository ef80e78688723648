"""Spark jobs for pixelated-detector scan data."""
