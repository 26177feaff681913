"""Spark-native analytics over grids, rasters and lattice graphs."""
