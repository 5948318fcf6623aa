"""Readers: radar track files, archives, Parquet tables, airspace files and adapters of other tables."""
