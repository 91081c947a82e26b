"""A PySpark engine that analyses source-code corpora as relations."""
