"""Column functions: text, identifiers, labels, model output."""
