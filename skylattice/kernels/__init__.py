"""Numerical kernels in numpy, free of Spark, shared by batch and streaming operators."""
