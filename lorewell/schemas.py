"""Schemas of the tables, files and messages the library reads."""

from __future__ import annotations

JOBS = (
    "doc_id string, user_id string, batch_id string, source_path string, status string, attempts int, "
    "error_msg string, metadata map<string,string>, created_at timestamp, updated_at timestamp, file_hash string"
)
JOB_EVENTS = "doc_id string, status string, error_msg string, ts timestamp, seq bigint"
CHATS = "thread_id string, user_id string, title string, created_at timestamp, updated_at timestamp"
MESSAGES = "id string, thread_id string, role string, content string, parts string, created_at timestamp"
FEEDBACK = (
    "id string, thread_id string, message_id string, user_prompt string, ai_response string, tools_used string, "
    "score int, user_correction string, timestamp timestamp"
)
RECORDS = "key string, namespace string, group_id string, updated_at double"
CHUNKS = (
    "source string, user_id string, filename string, created_at timestamp, document_date_str string, "
    "custom_date boolean, chunk_index bigint, chunk_type string, chunk_title string, chunk_summary string, "
    "doc_type string, content string, chunk_key string"
)
TABLES = {"jobs": JOBS, "chats": CHATS, "messages": MESSAGES, "feedback": FEEDBACK, "records": RECORDS}

# column names of an exported run report, and the names used here
RUN_COLUMNS = {
    "Run ID": "run_id", "Name": "name", "Start Time": "start_time", "Latency (ms)": "latency_ms", "Status": "status",
    "User ID": "user_id", "Thread ID": "thread_id", "Test Type": "test_type", "Tags": "tags",
    "Prompt Tokens": "prompt_tokens", "Completion Tokens": "completion_tokens", "Total Tokens": "total_tokens",
    "Total Cost ($)": "total_cost",
}
RUN_TYPES = {
    "start_time": "timestamp", "latency_ms": "double", "prompt_tokens": "bigint", "completion_tokens": "bigint",
    "total_tokens": "bigint", "total_cost": "double",
}
RUNS = ", ".join(f"`{label}` {RUN_TYPES.get(name, 'string')}" for label, name in RUN_COLUMNS.items())

GOLDEN = (
    "name string, category string, raw_text string, ideal_chunks array<string>, eval_query string, "
    "expected_answer string"
)
GOLDEN_PAIR = "input string, actual_output string, expected_output string, feedback_type string"

# one message of the document-event topic, and the JSON in its value
MESSAGE = "key string, value string, headers array<struct<key:string,value:string>>, timestamp timestamp"
DOCUMENT_EVENT = (
    "doc_id string, filename string, user_id string, content string, object_name string, metadata map<string,string>"
)
