"""tessera: entity resolution, scoring and corpus preparation as Spark plans."""
