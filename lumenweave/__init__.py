"""lumenweave: a Spark-first engine for indexing, searching and curating mixed-media corpora."""
