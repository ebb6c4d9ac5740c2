"""Code and text intelligence as Spark plans: graph questions, chunk catalogues, vector search and replayed state."""
