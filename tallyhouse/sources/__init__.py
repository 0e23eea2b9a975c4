"""Reading tables and catalogs, writing catalogs, CSV and per-user bundles."""
