"""Landed payloads in, normalised postings out."""
