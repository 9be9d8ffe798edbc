"""opslens: database-operations analytics as Spark DataFrame operators."""
