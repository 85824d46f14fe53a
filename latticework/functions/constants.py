"""Word lists, thresholds and patterns."""

# Words that are never keywords of a task.
STOP_WORDS = ["a", "add", "an", "and", "com", "da", "das", "de", "do", "dos", "e", "em", "for", "in", "na", "no", "of", "on", "or", "para", "que", "support", "the", "to", "um", "uma", "with"]

# Patterns whose matches are redacted, in this order, with what replaces them.
REDACTIONS = [
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED]"),
    (r"\bAccountKey=[A-Za-z0-9+/=]{20,}", "AccountKey=[REDACTED]"),
    (r"(?im)(\b\w*(?:password|secret|token|api[_-]?key|credential|private[_-]?key)\w*\s*[:=]\s*)([^\s#;,]+)", "$1[REDACTED]"),
    (r"(?i)(Bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]"),
]

# Patterns of secrets in source, by kind, with their severity.
SECRET_LITERAL = r"(?i)\b\w*(?:password|secret|token|api[_-]?key|credential)\w*\s*[:=]\s*['\"][^'\"]+['\"]"
CREDENTIAL_LITERAL = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bAccountKey=[A-Za-z0-9+/=]{20,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"

# Thresholds and vocabularies of findings.
FAN_THRESHOLD = 4
COMPONENT_FAN_THRESHOLD = 5
READ_METHODS = ["GET", "HEAD", "OPTIONS"]
BROAD_TYPES = ["error", "exception", "runtimeexception", "throwable"]
NON_IDEMPOTENT_METHODS = ["PATCH", "POST"]
CLIENT_ERROR_KINDS = ["authorization", "conflict", "not_found", "rate_limit", "validation"]
QUEUE_REDRIVE_KEYS = {"aws_sqs_queue": ["redrive_policy"], "AWS::SQS::Queue": ["RedrivePolicy"]}
ENCRYPTION_KEYS = {
    "aws_sqs_queue": ["kms_master_key_id"],
    "AWS::SQS::Queue": ["KmsMasterKeyId"],
    "aws_s3_bucket": ["server_side_encryption_configuration", "encryption_configured"],
    "AWS::S3::Bucket": ["BucketEncryption"],
}
VERSIONING_KEYS = {"aws_s3_bucket": ["versioning", "versioning_configured"], "AWS::S3::Bucket": ["VersioningConfiguration"]}
PUBLIC_VALUES = {
    "acl": ["public-read", "public-read-write", "authenticated-read"],
    "AccessControl": ["PublicRead", "PublicReadWrite", "AuthenticatedRead"],
    "container_access_type": ["blob", "container"],
}
FLOW_KINDS = ["invokes", "injects", "validates", "reads", "writes", "publishes", "consumes"]
OBSERVATION_SOURCES = ["otel", "broker"]
LONGEST_NAME = 256
SEMANTIC_FLOOR = 0.35
PAGE_DEFAULT, PAGE_MOST = 50, 500
