"""Operators for preparing large text corpora, their queries and their SQL.

Nothing outside this subpackage imports it. Each module holds one operator
with a general interface; ``queries`` binds them to the tables.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with the tasks that call them, so
# executors need no copy of the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
