"""Vessel-track and radar-scene analytics as composable PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors with their helpers, so a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
