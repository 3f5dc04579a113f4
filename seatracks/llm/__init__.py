"""Operators for training-data pipelines: one module per operator, queries in ``queries``."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this subpackage's code, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
