"""The named operators, one module per category."""
