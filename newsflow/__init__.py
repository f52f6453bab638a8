"""Financial-news analytics as Spark DataFrame transformations."""
