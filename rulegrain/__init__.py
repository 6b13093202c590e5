"""Rule-quality analytics on Spark: text relations in, findings relations out."""
