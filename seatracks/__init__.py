"""Spark jobs over ship-position tracks: tokens, gap windows, fills, scores and comparisons."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
