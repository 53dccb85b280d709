"""A context, retrieval and corpus analytics engine on PySpark."""
