"""DataFrame -> DataFrame operators and ``pyspark.ml`` estimators."""
