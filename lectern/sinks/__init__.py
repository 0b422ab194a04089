"""Writers of books: files by path, raw and clean sets, chunks."""
