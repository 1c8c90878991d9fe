"""varietas — text variation and n-gram language-model analytics on Spark DataFrames."""

__version__ = "0.1.0"
