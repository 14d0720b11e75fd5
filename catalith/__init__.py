"""catalith: a PySpark-native engine for catalog metadata.

Ingest, normalise, merge, resolve, publish and search package and community
metadata with DataFrame plans.  ``catalith.llm`` (optional) adds the operators
for training data; nothing else in the library imports it.

Functions that run in Python workers are sent by value, so a cluster needs no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
