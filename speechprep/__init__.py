"""Data work for turning written articles into speech, as Spark DataFrame operators."""
