"""Reading and writing tables, vectors and the feedback log."""
