"""dealtide: retail promotion and first-party event analytics on PySpark."""

__version__ = "0.1.0"
