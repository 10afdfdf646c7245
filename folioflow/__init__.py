"""folioflow: document-data analytics expressed as Spark DataFrame plans."""
