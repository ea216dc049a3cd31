"""A PySpark-native engine for property graphs, constraint checks, change logs and text corpora."""
