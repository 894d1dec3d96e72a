"""Operators for large training-data pipelines, one module each, and their registered queries."""

import sys

from pyspark import cloudpickle

# Helpers travel with the tasks, so executors need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
