"""Writers of token streams and text files."""
