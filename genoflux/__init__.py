"""genoflux: statistical genetics and table analytics as Spark jobs."""
