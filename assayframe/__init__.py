"""Dataset quality and privacy-risk assessment as Spark plans."""

__version__ = "0.1.0"
