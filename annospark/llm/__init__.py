"""Preparation of large text collections: duplicates, mixing, sharding, toxicity, page extraction and scans.

Nothing else in the library imports this package. The operators work on *label files*, the text records of
the library (``stem`` names the file, ``text`` is its content), and on anything else that has those columns.
"""

import sys

from pyspark import cloudpickle

# tasks carry the code of this package along, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
