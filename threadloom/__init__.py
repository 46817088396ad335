"""Analytics over scored chat conversations, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
