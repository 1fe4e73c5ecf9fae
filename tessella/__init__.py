"""Chunked evidence analytics on Spark: objects, files, chunks, segments and extents as DataFrames."""
