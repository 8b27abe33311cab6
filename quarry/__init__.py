"""quarry: code-metric analytics and policy queries expressed as Spark DataFrame plans."""
