"""All registered queries: importing this module imports every module that registers some."""

from . import aggregates, baselines, celestial, chain, corrections, files, graph, joins, kernels, lifecycle, scalars, streams, textio, views  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
