"""Coastal wave-exposure analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel with their code, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
