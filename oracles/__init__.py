"""SQL twins of the registered queries, written against the benchmark tables alone."""
