"""Routing and analytics of multilingual support tickets as Spark jobs."""

import sys

from pyspark import cloudpickle

# Column functions that run in Arrow workers travel with the query, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
