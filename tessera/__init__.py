"""tessera: Spark-native analytics for labelled text corpora.

Every operator is a function ``DataFrame -> DataFrame`` (or a Column
expression) built from native Spark SQL functions, so Catalyst can prune,
push down and codegen the whole pipeline.
"""

__version__ = "0.1.0"
