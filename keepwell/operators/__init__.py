"""The pipeline's operators, each a DataFrame in, DataFrame out."""
