"""Offline risk analytics for collections of untrusted text packages, as Spark DataFrames."""
