"""Full-text search and text preparation as Spark DataFrame plans."""
