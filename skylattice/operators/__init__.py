"""Relational operators as DataFrame transformations, and the numerical kernels they call."""
