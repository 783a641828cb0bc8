"""Calibration and regression of instrument time series as Spark jobs.

Sub-packages
------------
``schema``      column roles, read schemas and feature presets
``functions``   column expressions (hashing, activations, network forward passes)
``operators``   DataFrame -> DataFrame operators and ``pyspark.ml`` estimators
``sources``     readers, writers, model persistence and the run registry
``streaming``   scoring of arriving files with a saved pipeline
``plans``       the query catalogue run by ``__spark_entry__.py``
"""

__version__ = "0.1.0"
