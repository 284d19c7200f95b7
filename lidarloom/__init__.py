"""Lidarloom: octree-indexed point clouds as DataFrames, from file structure to tiles."""
