"""Column functions: everything here returns a Spark ``Column``."""
