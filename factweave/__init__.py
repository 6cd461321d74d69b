"""factweave: evidence-grounded fact resolution as Spark DataFrame plans."""

__version__ = "0.1.0"
