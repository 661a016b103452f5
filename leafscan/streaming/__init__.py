"""Pages from a stream of files. Not a capability that the page operators had before: the batch plan, fed file by file."""
