"""Tarnfold: analytics over agent logs, code indexes and text corpora, written as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
