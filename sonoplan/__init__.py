"""Time-frequency and spatial-frequency analytics as Spark DataFrame plans."""
