"""Study-content analytics and document processing as PySpark DataFrame programs."""
