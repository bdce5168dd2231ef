"""sources of folioform."""
