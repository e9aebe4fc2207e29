"""A relational engine on PySpark: a small SQL dialect, typed tables, transactions."""
