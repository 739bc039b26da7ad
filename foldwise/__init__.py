"""Leakage-aware evaluation of grouped datasets, as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
