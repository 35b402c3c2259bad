"""Functions of the sensor analytics library."""
