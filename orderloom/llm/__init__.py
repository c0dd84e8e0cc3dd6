"""Training-data operators: text quality, privacy, duplicates, tokens and archives.

Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package installed
