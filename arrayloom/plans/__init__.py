"""The registered queries. Importing this package fills the registry."""

from . import arrays, features, files, models, origins, resampling, signals, statistics  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
