"""Cohort-risk analytics on PySpark: folds, scores, thresholds, fusion, explanation."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with the task, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
