"""operators of folioform."""
