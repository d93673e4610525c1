"""Evidence-mining operators for paired read evidence, written as Spark DataFrame plans."""
