"""Training-data operators: tokenising, filtering, de-duplication, mixing and
search over the documents, labels, embeddings and conversations tables.  Nothing outside this
subpackage imports it (``__spark_entry__`` adds its queries only if it is
there)."""
