"""Column functions: text, dates and ratios, all JVM-side expressions."""
