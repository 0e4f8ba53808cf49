"""drillspark: explain what changed in a dataset, with the evidence, on Spark."""

__version__ = "0.1.0"
