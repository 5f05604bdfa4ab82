"""Column functions: statistics, metrics, distances, patterns."""
