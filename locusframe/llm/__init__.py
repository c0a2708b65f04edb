"""Training-data operators: ten corpus-scale components and their queries.

Nothing outside this folder imports it.  Functions sent to Python workers are
pickled by value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
