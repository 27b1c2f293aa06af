"""Document analytics and hybrid retrieval as DataFrame plans."""
