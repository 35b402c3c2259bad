"""Operators of the sensor analytics library."""
