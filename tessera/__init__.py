"""A PySpark engine for index-keyed data: vectors, matrices, grids, meshes and batches of arrays, as DataFrames."""
