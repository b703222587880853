"""sievework: certified document screening and text-corpus analytics as Spark plans."""
