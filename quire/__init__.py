"""quire: document composition over DataFrames (pages, spreads, sheets, sources) as Spark jobs."""
