"""quire: document-text evaluation and corpus preparation on PySpark."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
