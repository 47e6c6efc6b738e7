"""Readers and writers. Formats that Spark doesn't read (PBF, GeoPackage, LAZ, GeoTIFF) come as Parquet, JSON or CSV extracts."""
