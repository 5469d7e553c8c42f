"""Editorial quality analytics as PySpark DataFrame transformations."""
