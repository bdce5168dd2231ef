"""Operators for preparing training data; nothing else in folioform imports this subpackage."""
