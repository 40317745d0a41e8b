"""What ``__spark_entry__`` registers of this subpackage and of the pipeline built on it."""

from carbonsplit.llm import queries, statements
from corpus_pipeline import ORACLE_SQL, run

QUERIES = {**queries.QUERIES, "pipeline": run}
STATEMENTS = {**statements.STATEMENTS, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
