"""Composable DataFrame operators for regulatory text, permits and geo data on Spark."""

import sys

from pyspark import cloudpickle

# Functions given to mapInArrow / applyInPandas travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
