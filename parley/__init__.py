"""parley: a Spark-native engine that turns chat history into training and
evaluation tables (clean -> context windows -> split -> extrapolate ->
encode/batch -> score), plus batch and streaming prompt building.

Every operator is a ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, windows, joins and aggregations.
"""

from parley.session import get_spark, ensure_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
