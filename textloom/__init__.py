"""A PySpark engine that scans document collections."""
