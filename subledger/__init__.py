"""Commerce and subscription analytics as plain Spark DataFrame transformations."""
