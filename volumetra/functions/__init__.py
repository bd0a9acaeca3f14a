"""Column functions: geometry, intervals, intensities, and the parsing of option values."""
