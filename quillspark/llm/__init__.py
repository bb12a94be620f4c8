"""Operators for training-data pipelines over language-model text.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries if it is there.
"""

#: Modules whose QUERIES and ORACLE the entry point adds.
MODULES = [f"quillspark.llm.{m}" for m in ("reading", "canon", "leaks", "spans", "cut", "consensus", "proportions", "mixing")]
