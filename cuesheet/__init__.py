"""Transcript and subtitle analytics over a corpus of media, built on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Task functions travel with their code, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
