"""lodestrand: analytics over text, code and graph relations, written as Spark DataFrame operators."""
