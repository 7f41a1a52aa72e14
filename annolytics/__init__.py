"""Spark-native preparation, judging and measurement of annotated records."""

import sys

from pyspark import cloudpickle

# Python stages carry this package's code with them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
