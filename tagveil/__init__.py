"""Find, tag, check and restore sensitive values in large tables of documents, on Spark."""
