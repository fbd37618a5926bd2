"""Navigable triangle-mesh surfaces as DataFrames."""
