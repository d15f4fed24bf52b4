"""tallyloom: comment, text and timeline analytics as Spark DataFrame plans."""
