"""Training-data operators over documents, pages and embeddings."""

import sys

from pyspark import cloudpickle

# What tasks run travels with them: executors need the libraries, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
