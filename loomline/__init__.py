"""loomline: log-sequence analytics as plain DataFrame -> DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# What Python workers run travels with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
