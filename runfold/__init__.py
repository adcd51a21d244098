"""Analysis and running of data pipelines on Spark: event streams, their fold, a run index and rules over graphs."""
