"""Sources: tables, CSV files, file listings, logs, job records."""
