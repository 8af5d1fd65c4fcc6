"""Reading and writing: paper sources, full texts, evaluation files, corpus tables."""
