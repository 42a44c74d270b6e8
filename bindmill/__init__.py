"""Structure-anchored bioactivity curation, splitting and evaluation on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function that takes its
column names as parameters, so the same code runs on protein and ligand tables
and on any other table with the same roles.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers with the task, so workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
