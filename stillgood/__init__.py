"""Spark operators that decide whether a stored answer is still good to reuse."""

import sys

from pyspark import cloudpickle

from .config import CacheConfig

# Functions run inside tasks travel with the job, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CacheConfig"]
