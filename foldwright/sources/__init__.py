"""Reading and writing: CSV and parquet tables, text exports, predictions, submissions, parameters."""
