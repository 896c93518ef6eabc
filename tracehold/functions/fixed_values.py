"""Fixed values.

Everything in this module is a value the results depend on: word lists,
thresholds, output formats and default texts. They are plain data, kept in one
place, and the operators take them as defaults of keyword arguments.
"""

# Event kinds kept by the archive extraction.
RECORD_KIND = "RECORD_EVENT"
KEPT_EVENT_TYPES = (
    "EVENT_EXECUTE",
    "EVENT_FORK",
    "EVENT_CLONE",
    "EVENT_CONNECT",
    "EVENT_ACCEPT",
    "EVENT_SENDTO",
    "EVENT_RECVFROM",
    "EVENT_OPEN",
    "EVENT_WRITE",
    "EVENT_MODIFY_FILE_ATTRIBUTES",
)

# Event kinds that make a file edge or a network edge.
FILE_EVENT_TYPES = (
    "EVENT_OPEN",
    "EVENT_WRITE",
    "EVENT_MODIFY_FILE_ATTRIBUTES",
    "openat",
    "security_file_open",
)
NETWORK_EVENT_TYPES = ("EVENT_CONNECT", "EVENT_ACCEPT", "socket", "connect")
DEFAULT_IP = "LOCAL_SOCKET"
DEFAULT_PORT = "ANY"

# Edge kinds.
SPAWNED = "SPAWNED"
ACCESSED = "ACCESSED"
CONNECTED_TO = "CONNECTED_TO"

# Texts that stand in for missing fields.
UNKNOWN_PROCESS = "UNKNOWN"
UNKNOWN_EVENT = "UNKNOWN"
UNKNOWN_TEXT = "unknown"
UNKNOWN_PARENT = "unknown_parent"
NO_PARENT_WORDS = ("null", "None")
BLANKS = ("", " ")

# File numbers of each split, and CSV file name of each split.
SPLIT_FILE_NUMBERS = {
    "Training": (1, 2, 3, 4, 5),
    "Validation": (15, 16, 17, 18, 19),
    "Testing": (35, 36, 37, 38, 39),
}
SPLIT_CSV_FILES = {
    "Training": "labelled_training_data.csv",
    "Validation": "labelled_validation_data.csv",
    "Testing": "labelled_testing_data.csv",
}
ARCHIVE_NUMBER_PATTERN = r"\.bin\.(\d+)\.gz$"

# Alert rules.
RISK_WORDS = ("tsm", "sshd", "wget", "curl", "chmod", "nc", "bash -i")
RISK_BOOST = 0.90
SCORE_CAP = 0.99
ALERT_THRESHOLD = 0.85
FIRST_LOGS = 2000
SHOWN_COMMAND_CHARS = 30

# Sizes of feature vectors, model layers and training.
SEED_COUNT = 100_000
FEATURE_WIDTH = 16
HIDDEN_WIDTH = 32
EPOCHS = 50
LEARNING_RATE = 0.01
SAMPLE_PER_CLASS = 20
SHOWN_FILES = 5
SHOWN_IPS = 3

# Layout of context texts and of the incident report.
NO_SHORT_CONTEXT = "No extended context found."
NO_LONG_CONTEXT = "No extended graph context found."
SHORT_CONTEXT_FORMAT = (
    "Grandparent: %s\n"
    "  └── Parent: %s\n"
    "        └── Target: %s"
)
LONG_CONTEXT_FORMAT = (
    "--- EXECUTION CHAIN ---\n"
    "Grandparent Process: %s\n"
    "  └── Spawned Parent: %s\n"
    "        └── Spawned Target: %s\n"
    "\n"
    "--- ARTIFACTS TOUCHED ---\n"
    "Files: %s\n"
    "Network IPs: %s"
)
REPORT_FORMAT = (
    "--- 1. GRAPH CONTEXT ---\n%s\n\n"
    "--- 2. THREAT ANALYSIS ---\n%s\n\n"
    "--- 3. STRATEGY ---\n%s\n\n"
    "--- 4. VERIFIED COMMANDS (Audited) ---\n%s"
)
CODE_FENCES = ("```bash", "```")

# Words that decide a verdict, label names, table header.
MALICIOUS_WORD = "malicious"
BENIGN_WORD = "benign"
LABEL_NAMES = {1: "Malicious", 0: "Benign"}
MATRIX_HEADER = (
    "Model Name",
    "Accuracy (%)",
    "Precision (%)",
    "Recall (%)",
    "F1-Score (%)",
    "Time (s)",
)
COMPARED_MODELS = (
    "phi4-mini",
    "qwen2.5-coder:7b",
    "llama3.1:8b",
    "deepseek-r1:14b",
    "codestral",
    "qwen3:32b",
)

# Key under which a decoder hands a binary value over in JSON.
BINARY_MARK = "base64"
