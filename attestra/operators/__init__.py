"""DataFrame transforms: chunking, scoring, ranking, joins, selection and metrics."""
