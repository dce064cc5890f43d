"""Operators for preparing training text at scale. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage that run in Python workers travel with the job, so workers need no copy on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
