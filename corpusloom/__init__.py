"""corpusloom: analytics over document collections as Spark plans."""
