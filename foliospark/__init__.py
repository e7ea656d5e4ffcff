"""Editorial analytics and document processing on PySpark."""
