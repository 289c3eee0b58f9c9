"""Daily market-panel analytics expressed as Spark DataFrame transformations."""
