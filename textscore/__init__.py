"""textscore: evaluation of written answers at corpus scale, on Spark."""

import sys

from pyspark import cloudpickle

# The few helpers that run in Python workers travel with their tasks, so executors
# need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
