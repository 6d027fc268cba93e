"""Code-review and text-corpus analytics as Spark DataFrame operators."""
