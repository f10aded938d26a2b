"""DataFrame operators: ordered passes, rules, scores, datasets, audits, events."""
