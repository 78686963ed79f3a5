"""A Spark engine for tiled vector-map data."""
