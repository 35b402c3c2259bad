"""Sources of the sensor analytics library."""
