"""Operators for preparing training data; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with the job, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
