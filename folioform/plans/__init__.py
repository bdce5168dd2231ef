"""plans of folioform."""
