"""Types and expressions that Spark does not have as such."""
