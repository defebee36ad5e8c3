"""Sources: raw sensor file layouts, exported marts, driver parquet tables."""
