"""Article extraction over page tables, expressed as Spark DataFrame plans."""
