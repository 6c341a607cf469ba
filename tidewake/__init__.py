"""Spark-native maritime observation, track and evidence analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions shipped to executors travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
