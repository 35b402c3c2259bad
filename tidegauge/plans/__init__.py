"""Plans of the sensor analytics library."""
