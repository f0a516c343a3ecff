"""Station incident analytics on PySpark."""
