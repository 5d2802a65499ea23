"""Spark jobs that screen mail archives and mail streams for phishing."""

import sys

from pyspark import cloudpickle

# functions that run inside Python workers are pickled by value, so that executors need no copy of the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
