"""A semantic catalogue of text records, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions used inside UDFs travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
