"""Spark-first analytics for agent runs, evaluation results and training-data curation."""
