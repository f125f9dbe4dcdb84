"""molframe: molecular structures and their preparation as Spark tables."""

__version__ = "0.1.0"
