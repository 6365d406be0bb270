"""The SQL dialect: parser, validation, joins, pruning, and the builder of DataFrames."""
