"""lexloom: a Spark-native engine for text corpora and next-word models."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to executors travel whole: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
