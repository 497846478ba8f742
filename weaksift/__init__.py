"""Weak-signal text evidence on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# The few Python functions of the package travel to the executors inside the task, so that
# nothing needs to be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
