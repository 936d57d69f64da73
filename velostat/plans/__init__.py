"""Query assembly: datasets, the query catalog and the SQL oracle."""
