"""seqloom: sequence-record analytics expressed as Spark DataFrame plans."""
