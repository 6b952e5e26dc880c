"""Column functions: text positions, rounding, word counts, syntax facts."""
