"""Sources and sinks: readers for CSV, Parquet and rows, chunked tables with transactions, results."""
