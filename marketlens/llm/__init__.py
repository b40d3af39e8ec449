"""Training-data operators: the corpus operators, each a Spark job over whole tables.

Nothing outside this package imports it; ``queries`` holds the registered
queries, ``oracle`` their DuckDB SQL.  The task functions of this package travel
to the executors by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
