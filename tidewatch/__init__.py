"""Audits of predicted series and of the datasets behind them, on Spark."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job, so executors need
# no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
