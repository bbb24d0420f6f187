"""tidemark: lakehouse quality, feature and scoring jobs written as Spark DataFrame plans."""
