"""A research-analytics engine on PySpark: point-in-time features, scoring, event studies, retrieval."""
