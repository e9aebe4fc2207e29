"""Operators for training-data pipelines. Nothing else in the library imports this package."""

from pyspark import cloudpickle

import brindle.llm as _package

# Python workers get these functions by value, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(_package)
