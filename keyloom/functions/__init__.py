"""Column functions: identities, JSON fields, texts, vectors."""
