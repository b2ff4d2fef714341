"""evalweave: DataFrame operators for evaluating and preparing language-model data on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
