"""Corpus validation, profiling, splitting, tokenisation and batching as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship this package's functions inside the tasks that use them, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
