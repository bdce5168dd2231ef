"""functions of folioform."""
