"""Posting analytics on Spark: acquisition tables, canonical addresses, merging, ranking and corpus preparation as DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions for Python workers travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
