"""strainspark: strain, abundance and marker analytics as lazy PySpark operators."""
