"""Where graphs come from and are kept: the catalog, the snapshot store, bulk views of tables, and the session over them."""
