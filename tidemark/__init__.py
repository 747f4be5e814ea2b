"""Customer acquisition and retention analytics as PySpark DataFrame operators."""
