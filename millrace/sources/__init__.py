"""Row generators, CSV and Parquet."""
