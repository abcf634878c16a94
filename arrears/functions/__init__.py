"""Column expressions: text, dates and business classifiers (all JVM-side)."""
