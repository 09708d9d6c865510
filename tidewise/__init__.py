"""Spark-native analytics over rainfall grids, road networks and evacuation routes."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
