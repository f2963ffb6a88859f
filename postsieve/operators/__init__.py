"""DataFrame-to-DataFrame operators: filters, joins, dedup, ledger, scoring, ranking, reports."""
