"""Volumetric microscopy data on Spark: voxel tables, block grids, region graphs."""
