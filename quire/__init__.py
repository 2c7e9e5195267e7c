"""quire: PDF collections as queryable tables on PySpark."""
