"""A Spark-native engine for documents as arguments: clauses, graphs, rankings, summaries."""
