"""Registered queries: what the driver and the benchmark run."""
