"""Spark-native analytics for assay imaging tables: tracks, boxes, plates, files."""

import sys

from pyspark import cloudpickle

# The few Python steps travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
