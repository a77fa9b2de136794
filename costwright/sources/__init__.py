"""Reading billing tables and writing result tables."""
