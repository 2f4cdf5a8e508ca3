"""Network-flow analytics on Spark DataFrames: filters, aggregation, Top-N statistics, enrichment, ingest and streaming."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
