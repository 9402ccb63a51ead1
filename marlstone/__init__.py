"""A Spark-native engine for document retrieval, incremental ingest, concept graphs and collection health."""
