"""quarrymap: source-code structure analytics and training-data operators on Spark."""
