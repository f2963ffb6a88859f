"""Column-level building blocks: text, terms and patterns, urls, salaries, html, responses."""
