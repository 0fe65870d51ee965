"""Scoring, calibration and rollout analytics for model responses on Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Functions of this package that run in Python workers travel with the task, so
# the package need not be installed on the executors.
register_pickle_by_value(sys.modules[__name__])
