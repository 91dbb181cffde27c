"""Texts, names and limits that results must carry exactly."""

# --- admission -------------------------------------------------------------
ALLOWED_EXTENSIONS = [".pdf", ".docx", ".txt", ".md", ".json", ".csv"]
MAX_FILE_BYTES = 1000 * 1024 * 1024
SKIP_STATUSES = ["queued", "processing", "succeeded"]
RETRY_STATUSES = ["failed", "dead", "deleted"]
TRANSIENT_ERRORS = ["ConnectionError", "TimeoutError", "TransientError", "transient"]
PERMANENT_ERRORS = ["FileNotFoundError", "FileNotFound", "ValueError", "PermanentError", "permanent"]
MAX_TASK_RETRIES = 5
RETRY_BASE_SECONDS = 60
DEAD_LETTER_WARNING = 10

# --- documents -------------------------------------------------------------
DOC_TYPES = [
    "meeting_notes",
    "class_notes",
    "project_planning",
    "technical_doc",
    "research_paper",
    "tutorial_guide",
    "brainstorming",
    "troubleshooting",
    "financial_legal",
    "general",
]
STRUCTURED_OVER_CHARS = 20000
CHUNK_CHARS = 1000
CHUNK_OVERLAP = 200
DEFAULT_TITLE = "Sin título"
DEFAULT_SUMMARY = "Sin resumen"
CONTEXT_PREFIX = "[Contexto Global de %s: %s]\n\n"

# --- retrieval -------------------------------------------------------------
K_MIN, K_MAX, K_DEFAULT, K_SIMPLE = 2, 7, 4, 3
OVERFETCH = 2.5
DOCUMENT_CONTEXT_CHUNKS = 4
ERROR_PREFIX = "ERROR_TOOL:"
EMPTY_QUERY_ERROR = "ERROR_TOOL: la query no puede estar vacía."
NOTHING_FOUND = "No encontré información relevante en la base de conocimientos."
CONTEXT_SEPARATOR = "\n\n---\n\n"

# --- web results -----------------------------------------------------------
WEB_RESULTS = 4
WEB_FULL_PAGES = 2
WEB_HEADER = "Resultados de la Búsqueda Profunda Web:\n\n"
WEB_NOTHING = "La búsqueda web no arrojó resultados útiles."
WEB_PAGE_LABEL = "[CONTENIDO EXTRAÍDO DE LA PÁGINA]: "
WEB_SNIPPET_LABEL = "[SNIPPET RESUMEN]: "

# --- tools and synthetic rows ---------------------------------------------
RETRIEVER_TOOL = "knowledge_base_retriever"
WEB_TOOL = "web_search"
NOTE_TOOL = "save_note_to_knowledge_base"
SEARCH_TOOLS = [RETRIEVER_TOOL, WEB_TOOL]
SYNTHETIC_PREFIX = "[SISTEMA]"
SUMMARY_PREFIX = "Resumen de la conversación hasta ahora:"
MAX_RETRIES = 2
CODE_MARKERS = ["tool_code", "default_api", "knowledge_base_retriever("]
NO_RESULT_MARKERS = ["No encontré", "La búsqueda web no arrojó"]
DECLINED_MARKERS = [
    "Lo siento, no pude obtener datos",
    "La búsqueda no arrojó resultados",
    "No encontré información",
]
TOOL_TEXT_LIMIT = 500
TOOL_TEXT_PLACEHOLDER = (
    "[Documentos recuperados y procesados por el RAG. Contenido removido para optimizar la memoria "
    "y evitar límite de Oracle.]"
)
COLLAPSE_AT_USER_ROWS = 4
NO_CONVERSATION = "No hay conversación previa."
PREVIOUS_ANSWERS = "Respuestas anteriores del agente:"
PREVIOUS_SUMMARY = "Resumen de conversación previa: "

# --- stream frames ---------------------------------------------------------
CORRECTION_NOTICE = "Corrigiendo imprecisiones detectadas..."
GRADING_NOTICE = "Evaluando relevancia de los documentos..."
HALLUCINATION_NOTICE = "Verificando alucinaciones..."

# --- evaluation ------------------------------------------------------------
SOURCE_MARKERS = ["### Fuentes", "**Fuentes**", "Fuentes:"]
THOUGHT_PREFIX = "[Pensamiento"
NO_ANSWER = "Error: El agente no generó una respuesta válida."
NO_CONTEXT = "No se utilizó contexto de recuperación en este turno."
THRESHOLDS = {
    "contextual_precision": 0.4,
    "contextual_recall": 0.6,
    "answer_relevancy": 0.7,
    "faithfulness": 0.85,
    "chunk_quality": 0.4,
    "coherence": 0.7,
}
AGENT_THRESHOLDS = {"faithfulness": 0.85, "answer_relevancy": 0.8}
REGRESSION_TOLERANCE = 0.05
CORRECTED_PREFIX = "(Corregido) "
PROTECTED_MARK = "eval_doc_fixed_"

# --- stream routing --------------------------------------------------------
MAX_CONSUMER_RETRIES = 3
UNKNOWN_FILE = "unknown_file"
