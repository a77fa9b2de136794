"""Cloud-cost analytics as PySpark DataFrame operators."""
