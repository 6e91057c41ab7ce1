"""Texts, formats and lists whose exact content the results depend on.

They reproduce the original application's observable outputs (messages, prompts, formats,
lookup lists); everything else in the package is our own design.
"""

# --- chunking ------------------------------------------------------------------------------------
DEFAULT_SIZE = 512
DEFAULT_OVERLAP = 50
UI_SIZE = 1000
UI_OVERLAP = 100
DEFAULT_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
SEMANTIC_PERCENTILE = 50.0

# --- file routing: suffix -> loader ---------------------------------------------------------------
LOADERS = {
    ".txt": "text", ".md": "text", ".pdf": "pdf", ".docx": "docx", ".html": "html", ".htm": "html",
    ".ipynb": "notebook", ".csv": "csv", ".xlsx": "excel", ".json": "json",
}
FIELD_SEPARATOR = " | "
SHEET_HEADER = "Sheet: "

# --- ingestion messages ---------------------------------------------------------------------------
MSG_NOT_FOUND = "File not found: {}"
MSG_NO_TEXT = "Could not extract text from {}"
MSG_EMPTY = "File {} is empty"
MSG_ALREADY = "File {} already processed (use overwrite=True to reprocess)"
MSG_PROCESSED = "Successfully processed {}: {} chunks"
UPLOAD_STATUS = ("Uploaded", "Processed", "Failed")

# --- stores, import and merge ---------------------------------------------------------------------
DEFAULT_STORE = "wissensbasis"
MSG_IMPORTED = "Successfully imported {} chunks"
MSG_SKIPPED = " (skipped {} duplicate chunks)"
MSG_MERGED = "Successfully merged {} documents ({} chunks)"
MSG_NEW_STORE = "Success: Database '{}' imported!\n\nDocuments: {}\nChunks: {}"
MSG_NEED_NAME = "Error: Please provide a name for the imported database"
MSG_NAME_TAKEN = "Error: Database '{}' already exists"
MSG_NEED_TWO = "Error: Please select at least 2 databases to merge"

# --- viewer and selection -------------------------------------------------------------------------
PAGE_SIZE = 1000
PREVIEW_CHARS = 100
ELLIPSIS = "..."
PAGE_INFO = "Page %d of %d (Chunks %d-%d of %d)"
PAGE_EMPTY = "Page 0 of 0"
SELECTED = "%d / %d selected"
NONE_SELECTED = "0 selected"

# --- training samples -----------------------------------------------------------------------------
STYLES = {
    "Factual Q&A": "Generate factual questions and accurate answers based on the content.",
    "Conversational": "Generate natural conversational exchanges like a helpful tutor.",
    "Socratic": "Generate Socratic-style questions that lead to deeper understanding.",
    "Problem-Solving": "Generate problem-based questions with step-by-step solutions.",
    "Multiple Choice": "Generate multiple choice questions with correct answers and explanations.",
}
STYLE_LINE = "\n\nStyle: "
JSON_FORMAT_REQUEST = ('Return response in JSON format:\n'
                       '{"instruction": "the question or instruction", "output": "the response or answer"}')
DEFAULT_SYSTEM_PROMPT = (
    "You are an expert educator creating training data for an AI assistant.\n"
    "Generate realistic and educational question-answer pairs.\n"
    "Always respond with valid JSON in this exact format:\n"
    '{"instruction": "the question", "output": "the detailed answer"}')
DEFAULT_TOPIC_PROMPT = (
    "Generate 1 educational question-answer pair about {topic}.\n"
    "Respond ONLY with JSON in this format:\n"
    '{"instruction": "question here", "output": "detailed answer here"}')
CHUNK_PLACEHOLDER = "{chunk}"
TOPIC_PLACEHOLDER = "{topic}"
MAX_TOKENS = 500
MAX_PARALLEL_REQUESTS = 5
FENCE_JSON = "```json"
FENCE = "```"
WRAP_INSTRUCTION = "Question based on {}"
ERROR_LINE = "Sample {}: {}"
INSTRUCTION_FORMAT = "### Instruction:\n{}\n\n### Response:\n{}"
PREVIEW_SAMPLES = 5
PREVIEW_OUTPUT_CHARS = 200
MISSING = "N/A"
SFT_MAX_TOKENS = 512
MSG_NONE_SELECTED = "No chunks selected. Please select at least one chunk."
MSG_MIN_SAMPLES = "Number of samples must be at least 1"
MSG_TOO_MANY = "Cannot generate {} samples from {} chunks"

# --- service status texts (connection tests) -------------------------------------------------------
STATUS_CLOUD_OK = " OpenRouter connection successful"
STATUS_BAD_KEY = "L Invalid API key"
STATUS_NO_CREDIT = "L Insufficient credits"
STATUS_LOCAL_OK = " Ollama connection successful"
STATUS_NO_MODEL = "L Model '{0}' not found. Run: ollama pull {0}"
STATUS_OTHER = "L Error {}: {}"
STATUS_BODY_CHARS = 100
CLOUD_PROVIDER = "openrouter"

# --- artifacts ------------------------------------------------------------------------------------
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]
SIZE_LAST_UNIT = "PB"
CONFIG_FILE = "config.json"
WEIGHT_SUFFIXES = [".safetensors", ".bin"]
CHECKPOINT_PREFIX = "checkpoint-"
EXPORT_TYPE = "Safetensors"
INVALID_NAME_CHARS = ["/", "\\", ":", "*", "?", '"', "<", ">", "|", "\0"]
