"""The row-level stages on streams."""
