"""tessella: a Spark-first engine that partitions map data (nodes, ways, relations) into tiles."""
