"""postweir: Spark jobs over captured social-media post streams and the text data sets derived from them."""

__version__ = "0.1.0"
