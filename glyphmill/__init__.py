"""glyphmill: exact text tokenization and token analytics as PySpark DataFrame operators."""

__version__ = "0.1.0"
