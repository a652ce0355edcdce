"""Ball-by-ball cricket analytics as Spark DataFrame plans."""
