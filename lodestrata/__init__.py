"""lodestrata: DataFrame operators that build, audit and compare labelled datasets on Spark."""
