"""Column functions; all are built-in expressions, so they stay inside generated code."""
