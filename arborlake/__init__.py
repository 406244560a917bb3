"""Arborlake: file-inventory analytics and corpus operators on Spark DataFrames."""
