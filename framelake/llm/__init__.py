"""Training-data operators: Spark jobs over a `documents` table, one module each."""
