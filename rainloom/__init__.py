"""rainloom: rainfall observation analytics expressed as Spark DataFrame plans."""
