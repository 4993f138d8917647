"""Training-data operators: thirteen independent jobs over documents, pages and embeddings."""
