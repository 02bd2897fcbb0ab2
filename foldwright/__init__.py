"""foldwright: fold-wise modelling, scoring and ensembling on Spark DataFrames."""
