"""Operators for training-data pipelines; nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers are sent whole, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
