"""File-synchronisation analytics as Spark DataFrame operators."""
