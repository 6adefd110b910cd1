"""spindle: corpus search, evaluation and reward analytics on PySpark."""
