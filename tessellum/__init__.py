"""A PySpark-native retrieval and corpus-preparation engine."""
