"""jobmill: job-market data operators and corpus jobs as Spark DataFrame functions."""
