"""Millrace: declarative dataflow pipelines and analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry this package's code with them, so a cluster needs no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
