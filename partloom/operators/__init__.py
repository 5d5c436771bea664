"""Table jobs: filters, joins, aggregates, ordered jobs, upserts and quality checks over DataFrames."""
