"""Activation analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code, so the executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
