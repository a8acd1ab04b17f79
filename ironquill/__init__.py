"""ironquill: code-security analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions and state classes travel to workers with the job: a worker need not have the driver's import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
