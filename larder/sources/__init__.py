"""Sources and sinks: catalogues, embeddings, indexes and metadata."""
