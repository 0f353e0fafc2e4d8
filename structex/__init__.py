"""Schema-first structured extraction over tables, expressed with Spark DataFrames."""
