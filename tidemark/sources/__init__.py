"""Reading data in: databases, files, streams, and the registry that names them."""
