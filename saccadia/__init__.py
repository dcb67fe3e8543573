"""Trial-structured event and sample analytics on PySpark."""
