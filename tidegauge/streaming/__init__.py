"""Streaming of the sensor analytics library."""
