"""Spark-native entity-pair analytics: operators are DataFrame -> DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
