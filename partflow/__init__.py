"""Quality decisions on production-line data, expressed as Spark DataFrame operators."""

__version__ = "0.1.0"
