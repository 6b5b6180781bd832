"""Shelfmark: set-at-a-time operators over large document corpora, on PySpark.

The package holds plain functions from DataFrames to DataFrames. Nothing here
keeps session globals; a caller passes tables in and gets a lazy plan back.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel whole, so executors need no copy of the
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
