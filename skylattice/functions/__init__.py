"""Scalar functions as column builders."""
