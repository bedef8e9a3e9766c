"""Spark-native feature engineering and model evaluation over tables."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job, so that it runs on a
# cluster without being installed on its machines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
