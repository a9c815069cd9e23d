"""Network-flow analytics and training-data preparation on PySpark."""
