"""Public-transport analytics expressed as Spark DataFrame transformations."""
