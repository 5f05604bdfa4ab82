"""Image-collection and feature analytics as PySpark plans."""
