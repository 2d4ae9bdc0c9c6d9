"""furlong: point-in-time race analytics as a library of Spark DataFrame operators."""

__version__ = "0.1.0"
