"""sitelens: page, site and corpus analytics expressed as Spark plans."""
