"""Flight-delay analytics expressed as Spark DataFrame transformations."""
