"""tessera: graphs, patches and embeddings as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel to the Python workers with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
