"""DataFrame operators: counting, gates, resampling, joins over history, audits."""
