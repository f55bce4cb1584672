"""Data quality, drift, matching and modeling operators for Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the package's Arrow functions by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
