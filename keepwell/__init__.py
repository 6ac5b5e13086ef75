"""keepwell: subscriber churn and retention analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the tasks, so the package need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
