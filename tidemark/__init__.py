"""Tidemark: a Spark-native engine for large collections of irregular time series."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
