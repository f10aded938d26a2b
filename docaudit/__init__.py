"""Accessibility audits and alt-text datasets as Spark DataFrame jobs."""
import sys

from pyspark import cloudpickle

# The few Python functions travel inside the tasks: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
