"""The projected graph, and the registered queries with their SQL."""
