"""Reading tables and files into the canonical schemas."""
