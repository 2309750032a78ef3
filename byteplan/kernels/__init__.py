"""Pure functions on bytes (NumPy and the standard library); no Spark here."""
