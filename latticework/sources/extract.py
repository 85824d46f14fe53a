"""Facts from source files: one pass over (path, text) rows, each file parsed on its own, typed facts out.

A fact is a row of kind, path, start_line, end_line and a map of named string fields; `facts_of` splits them by kind. Only what
a file says literally becomes a fact: literal routes, channels, hosts, keys and names. The parser knows functions by their
declarations and braces (or indentation), strips comments without moving lines, and applies a table of rules for each language.
A file that cannot be parsed gives no facts. Null texts give none.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators import paths
from latticework.sources import cloud_clients, openapi, queues, routes
from latticework.sources.folders import checkpointed, workers_find_us

SCHEMA = "kind string, path string, start_line int, end_line int, fields map<string,string>"
Fact = tuple[str, int, int, dict[str, str]]

# Names of HTTP statuses that code may spell out.
STATUS = {"BAD_REQUEST": 400, "UNAUTHORIZED": 401, "FORBIDDEN": 403, "NOT_FOUND": 404, "CONFLICT": 409, "GONE": 410, "UNPROCESSABLE_ENTITY": 422, "TOO_MANY_REQUESTS": 429, "INTERNAL_SERVER_ERROR": 500, "BAD_GATEWAY": 502, "SERVICE_UNAVAILABLE": 503, "GATEWAY_TIMEOUT": 504,
          "BadRequest": 400, "Unauthorized": 401, "Forbidden": 403, "NotFound": 404, "Conflict": 409, "UnprocessableEntity": 422, "TooManyRequests": 429, "InternalServerError": 500, "BadGateway": 502, "ServiceUnavailable": 503, "GatewayTimeout": 504}
ERROR_KINDS = {400: "validation", 401: "authorization", 403: "authorization", 404: "not_found", 409: "conflict", 422: "validation", 429: "rate_limit"}
# Words in the last part of a call that tell what it does.
CALL_KINDS = {
    "publishes": ["publish", "convertandsend", "sendmessage", "writemessages", "emit", "producer.send", "kafkatemplate.send"],
    "writes": ["save", "insert", "update", "delete", "persist", "create", "upsert", "remove", "exec"],
    "reads": ["find", "get", "query", "select", "fetch", "load", "read", "list", "count", "exists"],
    "validates": ["validate", "verify", "authorize", "assert"],
}
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "new", "func", "function", "fun", "else", "try", "when", "await", "throw", "super", "def", "class", "with", "elif", "match", "defer", "go", "select", "range"}


def line_at(text: str, offset: int) -> int:
    return text.count("\n", 0, offset) + 1


def blanked(text: str, pattern: str) -> str:
    """The text with matches blanked, line breaks kept."""
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)


def without_comments(text: str) -> str:
    """C-like comments blanked; strings keep what looks like one."""
    return re.sub(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|//[^\n]*|/\*.*?\*/", lambda m: m.group() if m.group()[0] in "\"'`" else re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)


def block_end(text: str, opening: int, pair: str = "{}") -> int:
    """Just past the brace that closes the one at `opening`, strings skipped; the end of the text if none does."""
    depth, i = 0, opening
    while i < len(text):
        c = text[i]
        if c in "\"'`":
            m = re.compile(r"(?:\\.|[^\\" + c + r"])*" + c, re.S).match(text, i + 1)
            i = m.end() if m else i + 1
            continue
        depth += (c == pair[0]) - (c == pair[1])
        i += 1
        if depth == 0:
            return i
    return len(text)


def expression_end(text: str, at: int) -> int:
    """Where the line ends on which the expression ends that begins there; brackets may go over lines."""
    while at < len(text) and text[at] not in "\n}":
        at = block_end(text, at, {"(": "()", "[": "[]", "{": "{}"}[text[at]]) if text[at] in "([{" else at + 1
    return at


def call_kind(target: str) -> str:
    low = target.lower()
    tail = low.rsplit(".", 1)[-1]
    for kind, words in CALL_KINDS.items():
        if any((w in low) if "." in w else tail.startswith(w) for w in words):
            return kind
    return "invokes"


def host_and_path(url: str) -> tuple[str, str] | None:
    """The service and path of a literal URL inside the cluster: one label, or one ending in .svc or .internal."""
    m = re.fullmatch(r"https?://([a-z][a-z0-9-]*)(?:\.[a-z0-9-]+)?(?:\.svc(?:\.cluster\.local)?|\.internal)?(?::\d+)?(/[^?#]*)?(?:[?#].*)?", url)
    return (m[1], m[2] or "/") if m and not re.search(r"\.(com|org|net|io|dev)\b", url) else None


# --- languages with braces ------------------------------------------------------------------------------------------

_JVM_METHOD = re.compile(r"(?P<notes>(?:@\w+(?:\([^)]*\))?\s*)*)(?:(?:public|private|protected|internal|override|open|suspend|static|final|abstract)\s+)*(?:fun\s+(?P<kname>\w+)\s*\(|(?:<[^>]+>\s+)?(?P<type>\w[\w<>\[\],.? ]*?)\s+(?P<jname>\w+)\s*\()", re.S)
_JVM_CLASS = re.compile(r"(?P<notes>(?:@\w+(?:\([^)]*\))?\s*)*)(?:(?:public|private|internal|open|final|abstract|data|sealed)\s+)*(?:class|interface|object)\s+(?P<name>\w+)", re.S)
_EXPRESSION = re.compile(r"\s*(?::\s*[\w.<>?, ]+?)?\s*=(?!=)\s*")
_GO_FUNC = re.compile(r"^func\s+(?:\(\s*\w+\s+\*?(?P<owner>\w+)\s*\)\s*)?(?P<name>\w+)\s*\(", re.M)
_NODE_FUNC = re.compile(r"(?:(?:export\s+)?(?:async\s+)?function\s+(?P<a>\w+)\s*\(|(?:const|let)\s+(?P<b>\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>|^\s+(?:async\s+)?(?P<c>\w+)\s*\([^)]*\)\s*(?::\s*[\w<>\[\]., |]+)?\s*\{)", re.M)
_CALL = re.compile(r"\b((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*)\s*\(")


def functions(text: str, language: str) -> Iterator[tuple[str, str, int, int, int]]:
    """(symbol, annotations, offset, start and end of the body) of each function."""
    if language == "jvm":
        owners = [(m.start(), block_end(text, text.find("{", m.end())) if "{" in text[m.end() :] else len(text), m["name"]) for m in _JVM_CLASS.finditer(text)]
        for m in _JVM_METHOD.finditer(text):
            name = m["kname"] or m["jname"]
            if name in KEYWORDS or (m["type"] or "").strip() in KEYWORDS | {""} and not m["kname"]:
                continue
            close = block_end(text, m.end() - 1, "()")
            owner = next((o for a, b, o in reversed(owners) if a <= m.start() < b), None)
            given = _EXPRESSION.match(text, close) if m["kname"] else None
            brace = None if given else re.compile(r"[^;{}=]*\{").match(text, close)
            if given:
                yield f"{owner}.{name}" if owner else name, m["notes"], m.start(), given.end(), expression_end(text, given.end())
            if not brace:
                continue
            yield f"{owner}.{name}" if owner else name, m["notes"], m.start(), brace.end(), block_end(text, brace.end() - 1)
    elif language == "go":
        for m in _GO_FUNC.finditer(text):
            brace = text.find("{", block_end(text, m.end() - 1, "()"))
            if brace >= 0:
                yield f"{m['owner']}.{m['name']}" if m["owner"] else m["name"], "", m.start(), brace + 1, block_end(text, brace)
    else:
        for m in _NODE_FUNC.finditer(text):
            name = m["a"] or m["b"] or m["c"]
            brace = text.find("{", m.end() - 1)
            if name not in KEYWORDS and brace >= 0:
                yield name, "", m.start(), brace + 1, block_end(text, brace)


def _signature(head: str) -> dict[str, str]:
    """The body parameter of a handler as a contract, where its type is told."""
    m = re.search(r"@RequestBody\b(?:\([^)]*\))?\s+(?:@\w+(?:\([^)]*\))?\s+)*(?:final\s+)?(?:(\w+)\s*:\s*([A-Z]\w*)(\?)?|([A-Z]\w*)(?:<[^<>]*>)?\s+(\w+))", head)
    if not m:
        return {}
    optional = bool(m[3]) or "required = false" in m[0]
    return {"contract": json.dumps({"request": {"name": m[1] or m[5], "required": not optional, "type": m[2] or m[4]}})}


def _spring(text: str) -> Iterator[Fact]:
    prefixes = [(m.start(), (re.search(r"@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"", m["notes"]) or ["", ""])[1]) for m in _JVM_CLASS.finditer(text)]
    for symbol, notes, at, body, end in functions(text, "jvm"):
        first, last = line_at(text, at + len(notes) - len(notes.lstrip())), line_at(text, end)
        prefix = next((p for a, p in reversed(prefixes) if a <= at), "")
        for m in re.finditer(r"@(Get|Post|Put|Patch|Delete)Mapping(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?(?:\"([^\"]*)\")?[^)]*\))?", notes):
            yield "entrypoint", first, last, {"transport": "http", "method": m[1].upper(), "name": joined_route(prefix, m[2] or ""), "symbol": symbol} | _signature(text[at:body])
        for m in re.finditer(r"@(QueryMapping|MutationMapping)", notes):
            yield "entrypoint", first, last, {"transport": "graphql", "method": "QUERY" if m[1][0] == "Q" else "MUTATION", "name": symbol.rsplit(".", 1)[-1], "symbol": symbol}
        for m in re.finditer(r"@(RabbitListener|KafkaListener)\([^)]*(?:queues|topics)\s*=\s*[\[{]?\s*\"([^\"]+)\"", notes):
            yield "entrypoint", first, last, {"transport": "message", "method": "CONSUME", "name": m[2], "symbol": symbol}
            yield "message_contract", first, last, {"direction": "consumes", "channel": m[2], "source": symbol, "transport": "rabbitmq" if m[1][0] == "R" else "kafka"}
        if "@Scheduled" in notes:
            yield "entrypoint", first, last, {"transport": "job", "method": "SCHEDULE", "name": symbol, "symbol": symbol}
        if "@Transactional" in notes:
            yield "boundary", first, last, {"source": symbol, "boundary": "transaction"}
        if m := re.search(r"@Retryable\([^)]*maxAttempts\s*=\s*(\d+)", notes):
            yield "policy", first, last, {"source": symbol, "policy": "retry", "mechanism": "spring_annotation", "value": m[1], "unit": "attempts"}
        if m := re.search(r"@ExceptionHandler\(\s*(\w+)(?:\.class|::class)", notes):
            status = re.search(r"(?:@ResponseStatus\(|HttpStatus\.)(?:HttpStatus\.)?([A-Z_]+)", notes + text[body:end])
            code = STATUS.get(status[1]) if status else None
            yield "error_contract", first, last, {"source": symbol, "role": "maps", "internal_type": m[1], "protocol": "http", "transport_code": str(code) if code else "", "error_kind": "timeout" if "Timeout" in m[1] else ERROR_KINDS.get(code or 0, "unknown"), "exposes_internal_detail": str(bool(re.search(r"\.(?:getMessage\(\)|(?:message|stackTrace|cause)\b)", text[body:end]))).lower()}
        for m in re.finditer(r"throw\s+(?:new\s+)?(\w+)\s*\(", text[body:end]):
            yield "error_contract", line_at(text, body + m.start()), line_at(text, body + m.end()), {"source": symbol, "role": "raises", "internal_type": m[1], "protocol": "internal", "transport_code": "", "error_kind": raised_kind(m[1])}
        for m in re.finditer(r"(\w+)\.(getForObject|getForEntity|postForObject|postForEntity|put|delete)\(\s*\"([^\"]+)\"", text[body:end]):
            if found := host_and_path(m[3]):
                verb = "GET" if m[2].startswith("get") else "POST" if m[2].startswith("post") else m[2].upper()
                yield "service_call", line_at(text, body + m.start()), line_at(text, body + m.end()), {"source": symbol, "target_service": found[0], "protocol": "http", "target_method": verb, "target_path": found[1]}
        for m in re.finditer(r"\.(get|post|put|patch|delete)\(\)\s*\.uri\(\s*\"([^\"]+)\"", text[body:end]):
            if found := host_and_path(m[2]):
                yield "service_call", line_at(text, body + m.start()), line_at(text, body + m.end()), {"source": symbol, "target_service": found[0], "protocol": "http", "target_method": m[1].upper(), "target_path": found[1]}
        for m in re.finditer(r"\.(retry|timeout)\(\s*(?:Duration\.of(Seconds|Millis)\()?(\d+)", text[body:end]):
            value = int(m[3]) * (1000 if m[2] == "Seconds" else 1)
            yield "policy", line_at(text, body + m.start()), line_at(text, body + m.end()), {"source": symbol, "policy": m[1], "mechanism": "reactor", "value": str(value), "unit": "retries" if m[1] == "retry" else "milliseconds"}
        for m in re.finditer(r"\b\w*[tT]emplate\.(convertAndSend|send)\(\s*\"([^\"]+)\"(?:\s*,\s*\"([^\"]+)\")?", text[body:end]):
            yield "message_contract", line_at(text, body + m.start()), line_at(text, body + m.end()), {"direction": "publishes", "channel": m[3] or m[2], "source": symbol, "transport": "rabbitmq" if m[1][0] == "c" else "kafka"} | ({"exchange": m[2] if m[3] else "", "routing_key": m[3] or m[2]} if m[1][0] == "c" else {})
    for m in re.finditer(r"@(Entity|Document)\b(?:\([^)]*\))?(?:\s*@Table\(\s*name\s*=\s*\"([^\"]+)\"[^)]*\))?[^{;]*?\bclass\s+(\w+)", text):
        yield "persistence", line_at(text, m.start()), line_at(text, m.end()), {"name": m[2] or m[3], "entity_kind": "sql_table" if m[1] == "Entity" else "document", "owner": m[3]}
    for m in re.finditer(r"@Value\(\s*\"\\?\$\{([^}:\"]+)", text):
        yield "configuration", line_at(text, m.start()), line_at(text, m.end()), {"config_key": m[1], "key_kind": "property"}


def _go(text: str) -> Iterator[Fact]:
    groups = {m[1]: m[2] for m in re.finditer(r"(\w+)\s*:?=\s*\w+\.Group\(\s*\"([^\"]*)\"", text)}
    for m in re.finditer(r"\b(\w+)\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete|HandleFunc)\(\s*\"(?:(GET|POST|PUT|PATCH|DELETE)\s+)?([^\"]+)\"\s*,\s*(?:\w+\.)?(\w+)", text):
        method = m[3] or ("GET" if m[2] == "HandleFunc" else m[2].upper())
        yield "entrypoint", line_at(text, m.start()), line_at(text, m.end()), {"transport": "http", "method": method, "name": joined_route(groups.get(m[1], ""), m[4]), "symbol": m[5]}
    for symbol, _, _, body, end in functions(text, "go"):
        part = text[body:end]
        for m in re.finditer(r"http\.(Get|Post)\(\s*\"([^\"]+)\"|http\.NewRequest(?:WithContext)?\((?:\w+,\s*)?(?:\"(\w+)\"|http\.Method(\w+))\s*,\s*\"([^\"]+)\"", part):
            if found := host_and_path(m[2] or m[5]):
                yield "service_call", line_at(text, body + m.start()), line_at(text, body + m.end()), {"source": symbol, "target_service": found[0], "protocol": "http", "target_method": (m[1] or m[3] or m[4]).upper(), "target_path": found[1]}
        for m in re.finditer(r"http\.Error\(\s*\w+\s*,\s*(.+?)\s*,\s*(?:http\.Status(\w+)|(\d{3}))\s*\)", part):
            code = STATUS.get(m[2] or "", int(m[3] or 0))
            yield "error_contract", line_at(text, body + m.start()), line_at(text, body + m.end()), {"source": symbol, "role": "maps", "internal_type": "", "protocol": "http", "transport_code": str(code), "error_kind": ERROR_KINDS.get(code, "unknown"), "exposes_internal_detail": str(bool(re.fullmatch(r"err\.Error\(\)", m[1]))).lower()}
        for m in re.finditer(r"\.Publish(?:WithContext)?\(\s*(?:\w+,\s*)?\"([^\"]*)\"\s*,\s*\"([^\"]+)\"", part):
            yield "message_contract", line_at(text, body + m.start()), line_at(text, body + m.end()), {"direction": "publishes", "channel": m[2], "source": symbol, "transport": "rabbitmq", "exchange": m[1], "routing_key": m[2]}
        for m in re.finditer(r"kafka\.Message\{[^}]*Topic:\s*\"([^\"]+)\"", part):
            yield "message_contract", line_at(text, body + m.start()), line_at(text, body + m.end()), {"direction": "publishes", "channel": m[1], "source": symbol, "transport": "kafka"}
        for m in re.finditer(r"\.Consume\(\s*\"([^\"]+)\"", part):
            yield "message_contract", line_at(text, body + m.start()), line_at(text, body + m.end()), {"direction": "consumes", "channel": m[1], "source": symbol, "transport": "rabbitmq"}
            yield "entrypoint", line_at(text, body + m.start()), line_at(text, body + m.end()), {"transport": "message", "method": "CONSUME", "name": m[1], "symbol": symbol}
        for m in re.finditer(r"os\.(?:Getenv|LookupEnv)\(\s*\"([^\"]+)\"", part):
            yield "configuration", line_at(text, body + m.start()), line_at(text, body + m.end()), {"config_key": m[1], "key_kind": "environment", "source": symbol}
    for m in re.finditer(r"type\s+(\w+)\s+struct\s*\{[^}]*(?:gorm\.Model|`gorm:)", text):
        yield "persistence", line_at(text, m.start()), line_at(text, m.end()), {"name": m[1], "entity_kind": "sql_table", "owner": m[1]}


def _node(text: str) -> Iterator[Fact]:
    for symbol, _, _, body, end in functions(text, "node"):
        part = text[body:end]
        for m in re.finditer(r"\baxios\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`$]+)['\"`]|\bfetch\(\s*['\"`]([^'\"`$]+)['\"`](?:\s*,\s*\{[^}]*method:\s*['\"](\w+)['\"])?", part):
            if found := host_and_path(m[2] or m[3]):
                yield "service_call", line_at(text, body + m.start()), line_at(text, body + m.end()), {"source": symbol, "target_service": found[0], "protocol": "http", "target_method": (m[1] or m[4] or "GET").upper(), "target_path": found[1]}
        for m in re.finditer(r"\.publish\(\s*['\"]([^'\"]*)['\"]\s*,\s*['\"]([^'\"]+)['\"]|\.sendToQueue\(\s*['\"]([^'\"]+)['\"]|\.send\(\s*\{\s*topic:\s*['\"]([^'\"]+)['\"]", part):
            yield "message_contract", line_at(text, body + m.start()), line_at(text, body + m.end()), {"direction": "publishes", "channel": m[2] or m[3] or m[4], "source": symbol, "transport": "kafka" if m[4] else "rabbitmq"} | ({} if m[4] else {"exchange": m[1] or "", "routing_key": m[2] or m[3]})
        for m in re.finditer(r"\bres(?:ponse)?\.status\((\d{3})\)\.(?:json|send)\(([^;]*)", part):
            if int(m[1]) >= 400:
                yield "error_contract", line_at(text, body + m.start()), line_at(text, body + m.end()), {"source": symbol, "role": "maps", "internal_type": "", "protocol": "http", "transport_code": m[1], "error_kind": ERROR_KINDS.get(int(m[1]), "unknown"), "exposes_internal_detail": str(bool(re.search(r"\berr(?:or)?\.(?:message|stack|cause)", m[2]))).lower()}
        for m in re.finditer(r"throw new GraphQLError\([^)]*code:\s*['\"](\w+)['\"]", part):
            yield "error_contract", line_at(text, body + m.start()), line_at(text, body + m.end()), {"source": symbol, "role": "raises", "internal_type": "GraphQLError", "protocol": "graphql", "public_code": m[1], "transport_code": "", "error_kind": "unknown"}
        for m in re.finditer(r"\.(?:bool|string|number|json)?[vV]ariation\(\s*['\"]([^'\"]+)['\"]", part):
            yield "feature_flag", line_at(text, body + m.start()), line_at(text, body + m.end()), {"provider": "launchdarkly", "flag_key": m[1], "source": symbol}
    for m in re.finditer(r"\.consume\(\s*['\"]([^'\"]+)['\"]", text):
        yield "message_contract", line_at(text, m.start()), line_at(text, m.end()), {"direction": "consumes", "channel": m[1], "source": "", "transport": "rabbitmq"}
    for m in re.finditer(r"process\.env(?:\.([A-Z_][A-Z0-9_]*)|\[\s*['\"]([^'\"]+)['\"]\s*\])", text):
        yield "configuration", line_at(text, m.start()), line_at(text, m.end()), {"config_key": m[1] or m[2], "key_kind": "environment"}
    for m in re.finditer(r"mongoose\.model\(\s*['\"](\w+)['\"]", text):
        yield "persistence", line_at(text, m.start()), line_at(text, m.end()), {"name": m[1], "entity_kind": "document", "owner": m[1]}


def _edges(text: str, language: str) -> Iterator[Fact]:
    for symbol, _, at, body, end in functions(text, language):
        yield "definition", line_at(text, at), line_at(text, end), {"symbol": symbol}
        for m in _CALL.finditer(text, body, end):
            if m[1].split(".")[0] not in KEYWORDS and m[1] != symbol.rsplit(".", 1)[-1]:
                yield "flow_edge", line_at(text, m.start()), line_at(text, m.end()), {"from_symbol": symbol, "to_symbol": m[1], "edge_kind": call_kind(m[1]), "origin": "static"}


def _clients(text: str, language: str) -> Iterator[Fact]:
    classes = [(m.start(), block_end(text, text.find("{", m.end())) if "{" in text[m.end() :] else len(text), m["name"]) for m in _JVM_CLASS.finditer(text)] if language == "jvm" else []
    yield from cloud_clients.facts_in(language, text, list(functions(text, language)) if language != "python" else [], classes)


def joined_route(prefix: str, route: str) -> str:
    both = f"{prefix.rstrip('/')}/{route.lstrip('/')}" if route else prefix
    return (both if both.startswith("/") else f"/{both}").rstrip("/") or "/"


def raised_kind(name: str) -> str:
    low = name.lower()
    for kind, words in {"not_found": ["notfound", "nosuch"], "validation": ["invalid", "validation", "illegalargument"], "authorization": ["unauthorized", "forbidden", "accessdenied"], "conflict": ["conflict", "duplicate", "already"], "rate_limit": ["ratelimit", "toomany"], "timeout": ["timeout"]}.items():
        if any(w in low for w in words):
            return kind
    return "unknown"


# --- Python ---------------------------------------------------------------------------------------------------------


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}".lstrip(".")
    return node.id if isinstance(node, ast.Name) else ""


def _python(text: str) -> Iterator[Fact]:
    tree = ast.parse(text)
    literal = lambda n: n.value if isinstance(n, ast.Constant) and isinstance(n.value, str) else None
    for node in ast.walk(tree):
        if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and d.args and (route := literal(d.args[0])) is not None and (verb := _dotted(d.func).rsplit(".", 1)[-1]) in ("get", "post", "put", "patch", "delete", "route"):
                yield "entrypoint", d.lineno, node.end_lineno or node.lineno, {"transport": "http", "method": "GET" if verb == "route" else verb.upper(), "name": joined_route("", route), "symbol": node.name}
            if _dotted(d.func if isinstance(d, ast.Call) else d).rsplit(".", 1)[-1] in ("command", "task"):
                kind = "cli" if "command" in _dotted(d.func if isinstance(d, ast.Call) else d) else "job"
                yield "entrypoint", d.lineno, node.end_lineno or node.lineno, {"transport": kind, "method": "RUN", "name": node.name, "symbol": node.name}
        for call in (n for n in ast.walk(node) if isinstance(n, ast.Call)):
            target, first = _dotted(call.func), literal(call.args[0]) if call.args else None
            at = {"source": node.name}
            if target and target.split(".")[-1] not in KEYWORDS:
                yield "flow_edge", call.lineno, call.end_lineno or call.lineno, {"from_symbol": node.name, "to_symbol": target, "edge_kind": call_kind(target), "origin": "static"}
            if target in ("os.getenv", "os.environ.get") and first:
                yield "configuration", call.lineno, call.lineno, at | {"config_key": first, "key_kind": "environment"}
            if re.fullmatch(r"(requests|httpx)\.(get|post|put|patch|delete)", target) and first and (found := host_and_path(first)):
                yield "service_call", call.lineno, call.lineno, at | {"target_service": found[0], "protocol": "http", "target_method": target.split(".")[1].upper(), "target_path": found[1]}


# --- schemas, migrations, declarations ------------------------------------------------------------------------------


def _proto(text: str) -> Iterator[Fact]:
    text = blanked(blanked(text, r"//[^\n]*"), r"/\*.*?\*/")
    for s in re.finditer(r"\bservice\s+(\w+)\s*\{", text):
        for m in re.finditer(r"\brpc\s+(\w+)\s*\(\s*(stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(stream\s+)?([\w.]+)\s*\)", text[s.end() : block_end(text, s.end() - 1)]):
            yield "entrypoint", line_at(text, s.end() + m.start()), line_at(text, s.end() + m.end()), {"transport": "rpc", "method": "UNARY" if not (m[2] or m[4]) else "STREAM", "name": f"{s[1]}/{m[1]}", "symbol": f"{s[1]}.{m[1]}", "request": m[3], "response": m[5]}


def _graphql(text: str) -> Iterator[Fact]:
    text = blanked(text, r"#[^\n]*")
    for s in re.finditer(r"\b(?:extend\s+)?type\s+(Query|Mutation)\s*\{", text):
        for m in re.finditer(r"(\w+)\s*(?:\(([^)]*)\))?\s*:\s*([\w\[\]!]+)", text[s.end() : block_end(text, s.end() - 1)]):
            yield "entrypoint", line_at(text, s.end() + m.start()), line_at(text, s.end() + m.end()), {"transport": "graphql", "method": s[1].upper(), "name": m[1], "symbol": f"{s[1]}.{m[1]}", "response": m[3]}


def _name(identifier: str) -> str:
    return identifier.strip("`\"[]").rsplit(".", 1)[-1].strip("`\"[]")


_SQL = [
    ("create_table", r"\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.`\"\[\]]+)", False), ("add_column", r"\bALTER\s+TABLE\s+([\w.`\"\[\]]+)\s+ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?([\w`\"\[\]]+)", False), ("drop_column", r"\bALTER\s+TABLE\s+([\w.`\"\[\]]+)\s+DROP\s+COLUMN\s+(?:IF\s+EXISTS\s+)?([\w`\"\[\]]+)", True),
    ("drop_table", r"\bDROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?([\w.`\"\[\]]+)", True), ("create_index", r"\bCREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?[\w`\"\[\]]+\s+ON\s+([\w.`\"\[\]]+)", False),
]


def _sql(text: str) -> Iterator[Fact]:
    text = blanked(blanked(blanked(text, r"--[^\n]*"), r"/\*.*?\*/"), r"'(?:''|[^'])*'")
    for operation, pattern, destructive in _SQL:
        for m in re.finditer(pattern, text, re.I):
            yield "migration", line_at(text, m.start()), line_at(text, m.end()), {"operation": operation, "table_name": _name(m[1]), "column_name": _name(m[2]) if m.lastindex and m.lastindex > 1 else "", "destructive": str(destructive).lower()}


def _liquibase(text: str) -> Iterator[Fact]:
    text = blanked(text, r"<!--.*?-->")
    for m in re.finditer(r"<(createTable|addColumn|dropColumn|dropTable|createIndex)\b([^>]*)>", text):
        if table := re.search(r"\btableName=\"([\w.]+)\"", m[2]):
            operation = re.sub(r"([A-Z])", lambda x: "_" + x[1].lower(), m[1])
            yield "migration", line_at(text, m.start()), line_at(text, m.end()), {"operation": operation, "table_name": _name(table[1]), "column_name": (re.search(r"\bcolumnName=\"(\w+)\"", m[2]) or ["", ""])[1], "destructive": str(m[1].startswith("drop")).lower()}


def _prisma(text: str) -> Iterator[Fact]:
    for m in re.finditer(r"^model\s+(\w+)\s*\{", text, re.M):
        yield "persistence", line_at(text, m.start()), line_at(text, block_end(text, m.end() - 1)), {"name": m[1], "entity_kind": "sql_table", "owner": m[1]}


# Declared resource types and what they are.
IAC = {"aws_sqs_queue": ("aws", "queue", "name"), "aws_sns_topic": ("aws", "pubsub", "name"), "aws_s3_bucket": ("aws", "object_storage", "bucket"), "aws_kinesis_stream": ("aws", "stream", "name"), "aws_cloudwatch_event_bus": ("aws", "event_bus", "name"), "google_pubsub_topic": ("gcp", "pubsub", "name"), "google_storage_bucket": ("gcp", "object_storage", "name"), "azurerm_storage_container": ("azure", "object_storage", "name"), "azurerm_servicebus_queue": ("azure", "queue", "name"),
       "AWS::SQS::Queue": ("aws", "queue", "QueueName"), "AWS::SNS::Topic": ("aws", "pubsub", "TopicName"), "AWS::S3::Bucket": ("aws", "object_storage", "BucketName"), "AWS::Kinesis::Stream": ("aws", "stream", "Name"), "AWS::Events::EventBus": ("aws", "event_bus", "Name")}


def _terraform(text: str) -> Iterator[Fact]:
    text = blanked(blanked(text, r"#[^\n]*"), r"/\*.*?\*/")
    split_settings: dict[str, set[str]] = {}
    for m in re.finditer(r"resource\s+\"(aws_s3_bucket_(?:versioning|server_side_encryption_configuration))\"\s+\"\w+\"\s*\{", text):
        if b := re.search(r"bucket\s*=\s*aws_s3_bucket\.(\w+)\.", text[m.end() : block_end(text, m.end() - 1)]):
            split_settings.setdefault(b[1], set()).add("versioning_configured" if "versioning" in m[1] else "encryption_configured")
    for m in re.finditer(r"resource\s+\"(\w+)\"\s+\"(\w+)\"\s*\{", text):
        if m[1] not in IAC:
            continue
        provider, kind, key = IAC[m[1]]
        end = block_end(text, m.end() - 1)
        body = text[m.end() : end - 1]
        attributes = {a[1]: a[2] if a[2] is not None else "true" for a in re.finditer(r"^\s*(\w+)\s*(?:=\s*(?:\"([^\"$]*)\"|\S[^\n]*)|\{)", body, re.M)}
        attributes |= {k: "true" for k in split_settings.get(m[2], ())} if m[1] == "aws_s3_bucket" else {}
        name = re.search(rf"^\s*{key}\s*=\s*\"([^\"$]+)\"", body, re.M)
        yield "iac_resource", line_at(text, m.start()), line_at(text, end), {"provider": provider, "resource_type": kind, "iac_resource_type": m[1], "logical_name": m[2], "physical_name": name[1] if name else "", "source_format": "terraform", "attributes": json.dumps(attributes, sort_keys=True)}


def _tree(text: str) -> list[tuple[int, int, str, str]]:
    """(line, indent, key, value) of the plain mappings of a YAML text; list marks count as indent."""
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        m = re.match(r"^(\s*(?:- )*)([\w.:/\-\"']+):(?:\s+(.*?))?\s*$", line)
        if m and not line.lstrip().startswith("#"):
            out.append((n, len(m[1]), m[2].strip("\"'"), re.sub(r"\s+#.*$", "", m[3] or "").strip("\"'")))
    return out


def _below(rows: list[tuple[int, int, str, str]], i: int) -> list[tuple[int, int, str, str]]:
    out = []
    for r in rows[i + 1 :]:
        if r[1] <= rows[i][1]:
            break
        out.append(r)
    return out


def _yaml(path: str, text: str) -> Iterator[Fact]:
    for document in re.split(r"^---\s*$", text, flags=re.M) if "{{" not in text else []:
        shift = text.index(document)
        first = line_at(text, shift) - 1
        rows = _tree(document)
        if any(r[2] == "Resources" and r[1] == 0 for r in rows):
            yield from _cloudformation(rows, first)
        elif any(r[2] == "services" and r[1] == 0 for r in rows) and re.search(r"compose", path):
            yield from _compose(document, rows, first)
        else:
            yield from _kubernetes(rows, first)


# Images of emulators, and the names of services as one of them lists them.
EMULATORS = {"localstack/localstack": "localstack", "mcr.microsoft.com/azure-storage/azurite": "azurite"}
EMULATED = {"sqs": "queue", "sns": "pubsub", "s3": "object_storage", "events": "event_bus", "kinesis": "stream"}


def _compose(document: str, rows: list, first: int) -> Iterator[Fact]:
    """What emulators stand for: the services that one lists, one resource each, or blobs; a list that is not there says nothing."""
    lines = document.split("\n")
    inner = _below(rows, next(i for i, r in enumerate(rows) if r[2] == "services" and r[1] == 0))
    for i, r in enumerate(inner):
        if r[1] != inner[0][1]:
            continue
        block = _below(inner, i)
        image = next((x for x in block if x[2] == "image"), None)
        kind = EMULATORS.get(re.sub(r":[\w.-]+$", "", image[3])) if image else None
        if kind is None:
            continue
        following = next((x[0] for x in inner[i + 1 :] if x[1] <= r[1]), len(lines) + 1)
        listed = re.search(r"^\s*(?:-\s*[\"']?)?SERVICES\s*[=:]\s*[\"']?([\w, -]+)", "\n".join(lines[r[0] : following - 1]), re.M)
        names = [EMULATED[n] for n in map(str.strip, listed[1].split(",")) if n in EMULATED] if listed and kind == "localstack" else []
        for resource in names if kind == "localstack" else ["object_storage"]:
            yield "iac_resource", first + image[0], first + image[0], {"provider": "aws" if kind == "localstack" else "azure", "resource_type": resource, "iac_resource_type": kind, "logical_name": r[2], "physical_name": "", "source_format": "compose_hint", "confidence": "low", "attributes": "{}"}


def _cloudformation(rows: list, first: int) -> Iterator[Fact]:
    start = next(i for i, r in enumerate(rows) if r[2] == "Resources" and r[1] == 0)
    inner = _below(rows, start)
    if not inner:
        return
    depth = inner[0][1]
    for i, r in enumerate(inner):
        if r[1] != depth:
            continue
        body = _below(inner, i)
        kind = next((x[3] for x in body if x[2] == "Type"), "")
        if kind not in IAC:
            continue
        provider, what, key = IAC[kind]
        p = next((j for j, x in enumerate(body) if x[2] == "Properties"), None)
        properties = {x[2]: x[3] or "true" for x in (_below(body, p) if p is not None else [])}
        name = properties.get(key, "")
        yield "iac_resource", first + r[0], first + (body[-1][0] if body else r[0]), {"provider": provider, "resource_type": what, "iac_resource_type": kind, "logical_name": r[2], "physical_name": name if name and not name.startswith("!") and "${" not in name else "", "source_format": "cloudformation", "attributes": json.dumps(properties, sort_keys=True)}


def _kubernetes(rows: list, first: int) -> Iterator[Fact]:
    kind = next((r[3] for r in rows if r[2] == "kind" and r[1] == 0), "")
    m = next((i for i, r in enumerate(rows) if r[2] == "metadata" and r[1] == 0), None)
    name = next((r[3] for r in _below(rows, m) if r[2] == "name"), "") if m is not None else ""
    if kind in ("ConfigMap", "Secret"):
        keys = sorted({x[2] for i, r in enumerate(rows) if r[2] in ("data", "stringData") and r[1] == 0 for x in _below(rows, i)})
        yield "k8s_source", first + 1, first + (rows[-1][0] if rows else 1), {"source_kind": "config_map" if kind == "ConfigMap" else "secret", "source_name": name, "keys": json.dumps(keys)}
        return
    if kind not in ("Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob", "Pod"):
        return
    container, role, variable = "", "application", ""
    for i, r in enumerate(rows):
        if r[2] in ("containers", "initContainers"):
            role = "application" if r[2] == "containers" else "initialization"
        scope = {"workload_kind": kind, "workload_name": name, "container_name": container, "container_role": role}
        if r[2] == "name" and any(x[2] == "valueFrom" for x in rows[i + 1 : i + 2]):
            variable = r[3]
        elif r[2] == "name" and any(x[2] in ("image", "env", "envFrom") and x[1] == r[1] for x in rows[i + 1 : i + 6]):
            container = r[3]
        elif r[2] in ("configMapKeyRef", "secretKeyRef"):
            ref = {x[2]: x[3] for x in _below(rows, i)}
            yield "k8s_binding", first + r[0], first + r[0] + len(ref), scope | {"environment_key": variable, "source_kind": "config_map" if r[2][0] == "c" else "secret", "source_name": ref.get("name", ""), "source_key": ref.get("key", "")}
        elif r[2] in ("configMapRef", "secretRef"):
            ref = {x[2]: x[3] for x in _below(rows, i)}
            yield "k8s_import", first + r[0], first + r[0] + len(ref), scope | {"source_kind": "config_map" if r[2][0] == "c" else "secret", "source_name": ref.get("name", ""), "optional": ref.get("optional", ""), "prefix": ""}


def facts_in(path: str, text: str | None) -> list[Fact]:
    """All facts of one file, by its name's ending; nothing for files that are not understood."""
    if not text:
        return []
    end = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    try:
        if end in ("java", "kt"):
            text = without_comments(text)
            return [*_spring(text), *_edges(text, "jvm"), *_clients(text, "jvm"), *queues.facts_in("jvm", text)]
        if end == "go":
            text = without_comments(text)
            return [*_go(text), *_edges(text, "go"), *_clients(text, "go"), *queues.facts_in("go", text)]
        if end in ("js", "jsx", "ts", "tsx", "mjs", "cjs"):
            text = without_comments(text)
            return [*_node(text), *routes.facts_in(path, text), *_edges(text, "node"), *_clients(text, "node"), *queues.facts_in("node", text)]
        rules = {"py": lambda t: [*_python(t), *_clients(t, "python")], "proto": _proto, "graphql": _graphql, "graphqls": _graphql, "sql": _sql, "xml": _liquibase, "prisma": _prisma, "tf": _terraform, "json": lambda t: openapi.facts_in(path, t)}
        if end in ("yaml", "yml"):
            return [*_yaml(path, text), *openapi.facts_in(path, text)]
        return list(rules[end](text)) if end in rules else []
    except (SyntaxError, ValueError, RecursionError):
        return []


def extract(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """All facts of all files: each file is read on its own; routes and clients are then put together over all of them."""
    facts = checkpointed(raw_facts(files, path, text))
    kinds = kinds_of(facts)
    if kinds & routes.KINDS:
        facts = checkpointed(routes.composed(facts))
    return cloud_clients.with_cloud(facts) if kinds & cloud_clients.KINDS else facts


def kinds_of(facts: DataFrame) -> set[str]:
    """The kinds of facts that there are: what has none needs no joins."""
    return {r["kind"] for r in facts.select("kind").distinct().collect()}


def raw_facts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """What each file says, with its routers, mounts and routes apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, p, a, b, list(f.items())) for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, a, b, f in facts_in(p, t)]
            kind, paths, start, end, fields = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(paths, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(fields, pa.map_(pa.string(), pa.string()))], ["kind", "path", "start_line", "end_line", "fields"])

    workers_find_us(files.sparkSession)
    return files.filter(f"{path} IS NOT NULL").select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def facts_of(facts: DataFrame, kind: str, *fields: str) -> DataFrame:
    """The facts of one kind, its fields as columns, with their evidence; empty fields are null."""
    evidence = F.struct(F.col("path").alias("file"), "start_line", "end_line").alias("evidence")
    return facts.filter(F.col("kind") == kind).select("path", *(F.nullif(F.col("fields")[f], F.lit("")).alias(f) for f in fields), evidence)


def called_definitions(facts: DataFrame, most: int = 3) -> DataFrame:
    """(path, caller, callee, start_line, end_line, place): what the definitions of a file call in the same file, at most so many each.

    A call belongs to the innermost definition around it, and means the first definition of its last name in the file. What lies
    within the caller's own lines is not told: it is the caller itself, or a part of it. Callees are in the order of their calls.
    """
    field = lambda n: F.col("fields")[n]
    known = facts.filter("kind = 'definition'").select("path", field("symbol").alias("symbol"), "start_line", "end_line")
    name = F.substring_index("symbol", ".", -1)
    first = known.groupBy("path", name.alias("_name")).agg(F.min(F.struct("start_line", "end_line", "symbol")).alias("_to"))
    calls = facts.filter("kind = 'flow_edge'").select("path", F.col("start_line").alias("line"), F.substring_index(field("to_symbol"), ".", -1).alias("_name")).distinct()
    inside = paths.innermost(calls, known.withColumnRenamed("symbol", "caller"), ["path"], name="caller").withColumnsRenamed({"start_line": "_from", "end_line": "_until"})
    met = inside.join(first, ["path", "_name"]).filter(~F.col("_to.start_line").between(F.col("_from"), F.col("_until")))
    one = met.groupBy("path", "caller", "_from", "_to").agg(F.min("line").alias("line"))
    place = F.row_number().over(Window.partitionBy("path", "caller", "_from").orderBy("line", "_to"))
    return one.withColumn("place", place).filter(F.col("place") <= most).select("path", "caller", F.col("_to.symbol").alias("callee"), "_to.start_line", "_to.end_line", "place")


def owned_operations(edges: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """Edges with the symbol of the entrypoint that is their source, if one is."""
    e = entrypoints.select(F.col("symbol").alias("_s")).distinct()
    return edges.join(e, edges["from_symbol"] == e["_s"], "left").withColumnRenamed("_s", "entrypoint")


def resolved_calls(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose bare target is rewritten to the only declared symbol that ends in it; others stay as they are."""
    tail = F.element_at(F.split("to_symbol", r"\."), -1)
    only = symbols.select("symbol").distinct().withColumn("_t", F.element_at(F.split("symbol", r"\."), -1)).groupBy("_t").agg(F.min("symbol").alias("_to"), F.count("*").alias("_n")).filter("_n = 1")
    out = edges.withColumn("_tail", tail).join(only, F.col("_tail") == F.col("_t"), "left")
    return out.withColumn("to_symbol", F.coalesce("_to", "to_symbol")).drop("_tail", "_t", "_to", "_n")


def linked_rpcs(handlers: DataFrame, declared: DataFrame) -> DataFrame:
    """Handlers with the declared RPC of their name, exact (high) or by the only one equal in lower case (medium)."""
    from latticework.operators.relational import exact_or_folded

    return exact_or_folded(handlers, declared, "name", "rpc")
