"""streaming of folioform."""
