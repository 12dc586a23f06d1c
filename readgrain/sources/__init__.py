"""Readers and writers: Parquet tables, JSON documents, delimited files, text lists, and what each phase saves."""
