"""Spark-native analytics over job postings: collect, clean, verify, group."""

import sys

from pyspark import cloudpickle

from postloom.config import Config, Layout

# Python tasks carry this package's functions with them, so executors need no
# copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Config", "Layout"]
