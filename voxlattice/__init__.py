"""Voxlattice: statistics over collections of aligned 3-D volumes, on Spark DataFrames."""
