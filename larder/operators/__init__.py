"""Relational operators: filtering, search, ranking, quality, schema mapping, embedding and prompts."""
