"""The registered queries: operators applied to panels that Spark derives from the tables, with SQL equivalents."""
