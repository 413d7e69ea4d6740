"""Relational building blocks: profiles, rules, duplicates, overlap, findings."""
