"""ridgeline: vector search, clustering and codecs as Spark DataFrame plans."""
