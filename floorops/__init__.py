"""PySpark jobs for operations logs, manufacturing reports, corpus curation and retrieval."""
