"""folioform: document-text processing on Spark DataFrames."""
