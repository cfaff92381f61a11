"""Spark-native engine for property-market records, price indices and map layers."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code: executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
