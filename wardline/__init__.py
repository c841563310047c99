"""wardline: evidence analytics and corpus preparation as Spark DataFrame plans."""
