"""Evidence selection, statistics, provenance and corpus operators as Spark DataFrame plans."""
