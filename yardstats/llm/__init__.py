"""Operations on text corpora for training data, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
