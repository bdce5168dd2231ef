"""They must be these for the results to be right."""

from __future__ import annotations

# Languages by code.
LANGUAGES = {
    "bg": "Bulgarian", "cs": "Czech", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "es": "Spanish", "et": "Estonian",
    "fi": "Finnish", "fr": "French", "ga": "Irish", "hr": "Croatian", "hu": "Hungarian", "it": "Italian", "lt": "Lithuanian", "lv": "Latvian",
    "mt": "Maltese", "nl": "Dutch", "pl": "Polish", "pt": "Portuguese", "ro": "Romanian", "sk": "Slovak", "sl": "Slovenian", "sv": "Swedish",
}

# Mean length of a translation from English over its source; Irish has none and takes the default.
EXPANSION = {
    "fr": 1.305, "es": 1.235, "de": 1.225, "it": 1.221, "pt": 1.210, "el": 1.204, "bg": 1.161, "ro": 1.152, "pl": 1.147, "hu": 1.138, "nl": 1.128, "mt": 1.115,
    "fi": 1.077, "lt": 1.070, "lv": 1.060, "et": 1.054, "sk": 1.038, "da": 1.029, "sv": 1.027, "sl": 1.001, "cs": 0.982, "hr": 0.970, "en": 1.000,
}
DEFAULT_EXPANSION = 1.15

# Engines, and the languages that the service engine lacks.
ENGINES = ("adaptive", "deepl", "llm")
SERVICE_LACKS = ("ga", "mt")

# English stopwords that show leaked source text.
STOPWORDS = (
    "the", "and", "of", "to", "in", "for", "with", "on", "by", "as", "is", "are", "that", "this", "from", "or", "be", "an", "at", "it", "which", "can", "also",
    "not", "under", "within", "without", "was", "were", "has", "have", "had",
)

# Words of contact labels.
CONTACT_WORDS = ("author", "authors", "case", "contact", "coordinator", "email", "e-mail", "further", "information", "page", "study", "web", "webpage", "website")

# Symbols that are drawn as another one.
SYMBOLS = {"“": '"', "”": '"', "„": '"', "‟": '"', "‘": "'", "’": "'", "❑": "□", "✓": "✔"}

# File types.
DOCUMENT_SUFFIXES = (".doc", ".docx", ".pdf", ".ppt", ".pptx", ".txt")
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".txt": "text/plain",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".ppt": "application/vnd.ms-powerpoint",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}

# Image types.
IMAGE_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp", ".svg": "image/svg+xml"}

# Counters whose non-zero value is a defect, and its label.
DEFECTS = {
    "blocks_residual_source": "residual_source_text",
    "blocks_unplaced": "unplaced_blocks",
    "blocks_rejected": "rejected_blocks",
    "segments_rejected": "rejected_segments",
    "image_blocks_rejected": "rejected_image_blocks",
}

# Block kinds.
KINDS = ("title", "abstract", "keywords", "paragraph", "line", "bullet", "label", "caption", "reference", "table", "image_text", "unknown")
BODY_KINDS = ("paragraph", "line", "bullet", "label")
NOT_SAMPLED_KINDS = ("caption", "reference", "table", "keywords", "label", "bullet")

# Tags whose text is not content.
SKIPPED_TAGS = ("script", "style", "meta", "link", "title")

# The mask that stands for text which must not change.
MASK_PREFIX, MASK_SUFFIX = "ZXQNT", "QXZ"
URL_TAIL = ".,;:!?)]}\"'"
