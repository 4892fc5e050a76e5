"""Training-data operators. Nothing outside this folder imports it, but for the top-level pipeline and the query registry."""
