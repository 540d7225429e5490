"""Training-data operators over the documents table."""
