"""Entity analytics on Spark: typed tables, finders, vectors, graphs, versions, events."""
