"""opinara: customer-review analytics and training-data operators as plain Spark DataFrame programs."""
