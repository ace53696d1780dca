"""Reading and writing: documents, listings, logs; sinks that are whole or absent."""
