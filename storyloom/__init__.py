"""storyloom: a Spark-native engine for documents, scripts and timelines."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their tasks, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
