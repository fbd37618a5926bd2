"""Streams of grids, point clouds and layer updates, and the current map that they keep."""
