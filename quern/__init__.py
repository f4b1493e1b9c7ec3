"""Quern: a SQLite-dialect analytics library built from PySpark DataFrame operators."""
