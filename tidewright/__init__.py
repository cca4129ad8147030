"""Point-in-time analytics on Spark: ordered, time-stamped data as DataFrame plans."""
