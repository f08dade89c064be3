"""Pure DataFrame-in, DataFrame-out operators of the document store."""
