"""wattloom: interval-meter analytics as Spark DataFrame transformations."""
