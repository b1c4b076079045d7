"""Spark-native concept index: chunking, term scoring, hyperbolic placement, sharding and retrieval."""
