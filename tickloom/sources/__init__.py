"""Reading, writing and normalising bars and tables."""
