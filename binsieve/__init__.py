"""Binned-index analytics on Spark: quantize, index and query columns by bins."""
