"""quire: search and analytics over a corpus of research papers, written as Spark jobs.

Everything is a function from DataFrames to a DataFrame.  ``Corpus`` bundles the
tables of one corpus and offers the functions as methods.
"""

import sys

from pyspark import cloudpickle

# Functions of the package travel to the tasks by value, so the workers of a
# cluster need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from quire.corpus import Corpus  # noqa: E402
from quire.session import get_session  # noqa: E402

__all__ = ["Corpus", "get_session"]
