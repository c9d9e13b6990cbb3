"""Training-data pipeline operators (text in, decisions out).

Each module holds one operator with its general interface; ``queries`` adds the
registered ``opN_*`` queries that apply them to whole tables.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that it need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
