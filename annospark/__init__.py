"""Object-annotation analytics as DataFrame operators for PySpark."""
