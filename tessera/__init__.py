"""tessera: analytics over a planetary cell grid, written as Spark plans."""
