"""Operators on meshes, layers, points and rays."""
