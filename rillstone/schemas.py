"""Schemas of the tables, declared once; nothing is inferred. Order columns make every first and last explicit."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _INT, _LONG, _BOOL, _TIME = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SIGNATURE = _table(params=T.ArrayType(_TEXT), return_type=_TEXT)

FILES = _table(file_ord=_INT, path=_TEXT, content=_TEXT, size=_LONG)
NODES = _table(
    node_identity=_TEXT, file_path=_TEXT, file_ord=_INT, node_ord=_INT, kind=_TEXT, name=_TEXT, start_line=_INT, end_line=_INT,
    exported=_BOOL, content_hash=_TEXT, signature=SIGNATURE,
)
IMPORTS = _table(file_path=_TEXT, import_ord=_INT, module=_TEXT, specifier=_TEXT)
EXPORTS = _table(file_path=_TEXT, export_ord=_INT, name=_TEXT, node_identity=_TEXT)
CALL_EDGES = _table(
    file_path=_TEXT, file_ord=_INT, edge_seq=_INT, caller=_TEXT, callee=_TEXT, line=_INT, col=_INT, unresolved=_BOOL, hint=_TEXT
)
ENTRY_POINTS = _table(entry_id=_TEXT, node_identity=_TEXT, kind=_TEXT, method=_TEXT, entry_ord=_INT)
REVIEW_EVENTS = _table(
    event_seq=_LONG, event_ts=_TIME, node_identity=_TEXT, scope=_TEXT, op=_TEXT, status=_TEXT, comment=_TEXT, code_hash=_TEXT,
    reviewer_id=_TEXT, reason=_TEXT,
)
COMMENTS = _table(
    comment_id=_LONG, anchor_kind=_TEXT, file_path=_TEXT, function_identity=_TEXT, line_start=_INT, line_end=_INT, body=_TEXT,
    reviewer_id=_TEXT, created_at=_TIME, archived_at=_TIME,
)
QUESTIONS = _table(key=_TEXT, kind=_TEXT, context=_TEXT, suggestion=_TEXT, alternatives=_TEXT, created_at=_TIME)
ANSWERS = _table(question_key=_TEXT, answer=_TEXT, answered_at=_TIME)
RULE_RESULTS = _table(rule_id=_TEXT, node_identity=_TEXT, kind=_TEXT, message=_TEXT)
PROJECT_RULES = _table(rule_id=_TEXT, label=_TEXT, definition=_TEXT, enabled=_BOOL)
RECENT_CODEBASES = _table(codebase_hash=_TEXT, path=_TEXT, label=_TEXT, last_opened_at=_TIME)
LLM_RESULTS = _table(input_hash=_TEXT, pipeline=_TEXT, prompt_version=_TEXT, model=_TEXT, response=_TEXT, created_at=_TIME, last_used_at=_TIME)
