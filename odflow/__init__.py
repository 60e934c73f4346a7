"""odflow: weighted travel-survey and origin-destination analysis on Spark DataFrames.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects (or
``Column`` expressions for the helpers in :mod:`odflow.functions`).  Nothing is
collected to the driver except scalar parameters such as a grid cell size.
"""

__version__ = "0.1.0"
