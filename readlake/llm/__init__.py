"""Training-data operators. Nothing outside this subpackage imports it; queries and SQL are in ``llm.queries``."""
