from . import charts, code, context, files, generations, inference, prompts, queries, records, references, state, tasks, text
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "charts", "code", "context", "files", "generations", "inference", "prompts", "queries", "records", "references", "state", "tasks", "text"]
