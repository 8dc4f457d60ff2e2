"""Spark-native fusion analytics: text reports and multi-source observations
in, source-cited analytic tables out.  Every operator is a function from
DataFrames to DataFrames."""
