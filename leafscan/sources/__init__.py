"""Where pages, documents, charsets and labelled lines come from."""
