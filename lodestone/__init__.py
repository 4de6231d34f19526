"""lodestone: document search, code-graph and corpus analytics written as Spark plans."""
