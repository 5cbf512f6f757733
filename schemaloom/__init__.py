"""schemaloom: JSON schema discovery as Spark aggregations."""
