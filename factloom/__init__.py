"""factloom: fact-table and code-graph analytics as Spark DataFrame operators."""
