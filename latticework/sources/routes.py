"""HTTP routes of Node applications: what each file says of routers, mounts and routes, and the joins that put whole paths together.

A route counts only on a proven receiver: an application or router made by a factory that the file imports, or the instance that
a registered plugin is given. Each file is read once for its routers (kind `router`), the places where routers are mounted
(`mount`), its routes (`route`), and the routers that it imports and exports; methods of controllers are entrypoints at once, as
their paths lie in one class. `composed` then links imports with exports, lets `paths.mounted` find where each router hangs, and
gives an entrypoint for each route of a router that hangs in one place. Paths, prefixes and decorators that are no literals leave
a route unsaid; nothing is guessed.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import paths

Fact = tuple[str, int, int, dict[str, str]]
# What the frameworks call methods and decorators, and the modules that decorators come from.
METHODS = ["get", "post", "put", "patch", "delete", "head", "options"]
CONTROLLER_METHODS = {"Get": "GET", "Post": "POST", "Put": "PUT", "Patch": "PATCH", "Delete": "DELETE"}
BINDINGS = {"Param": "path", "Query": "query", "Headers": "header"}
REGISTRATIONS = {"UseGuards": "route_guards", "UsePipes": "validation_pipes"}
OTHER_DECORATORS = {
    ("@nestjs/cache-manager", "CacheKey"): "cache_decorators",
    ("@nestjs/cache-manager", "CacheTTL"): "cache_decorators",
    ("@nestjs/throttler", "Throttle"): "rate_limit_decorators",
}
#: Kinds of facts that only `composed` reads.
KINDS = {"router", "mount", "route", "route_export"}
ENDINGS = r"\.(ts|tsx|js|jsx|mjs|cjs)$"

_STRING = r"'((?:[^'\\\n]|\\.)*)'|\"((?:[^\"\\\n]|\\.)*)\"|`([^`$\\]*)`"
_IMPORT = re.compile(r"\bimport\s+(?:(?:\*\s+as\s+)?(\w+)\s*,?\s*)?(?:\{([^}]*)\}\s*)?from\s*['\"]([^'\"]+)['\"]")
_REQUIRE = re.compile(r"\b(?:const|let|var)\s+(?:(\w+)|\{([^}]*)\})\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)(?:\.(\w+))?")
_MADE = re.compile(r"\b(?:const|let|var)\s+(\w+)(?:\s*:\s*[\w.<>]+)?\s*=\s*(?:new\s+)?(\w+)(?:\.(\w+))?\s*\(")
_TAKER = re.compile(r"\bfunction\s+(\w+)\s*\(\s*(\w+)|\b(?:const|let|var)\s+(\w+)(?:\s*:\s*[\w.<>]+)?\s*=\s*(?:async\s*)?\(\s*(\w+)")
_ON = re.compile(r"(?<![\w.])(\w+)\s*\.\s*(get|post|put|patch|delete|head|options|use|route|register)\s*\(")
_THEN = re.compile(r"\s*\.\s*(\w+)\s*\(")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_PARENS = r"\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)"
_DECORATOR = re.compile(rf"@(\w+)\s*({_PARENS})?\s*")
_CLASS = re.compile(rf"((?:@\w+\s*(?:{_PARENS})?\s*)*)(?:export\s+)?(?:default\s+)?(?:abstract\s+)?\bclass\s+(\w+)")
_METHOD = re.compile(rf"((?:@\w+\s*(?:{_PARENS})?\s*)+)(?:(?:public|private|protected|static|async)\s+)*(\w+)\s*\(")
_PARAMETER = re.compile(r"(?:(?:public|private|protected|readonly)\s+)*(\w+)(\?)?\s*:\s*(\w+)\s*(=.*)?", re.S)


def line_at(text: str, offset: int) -> int:
    return text.count("\n", 0, offset) + 1


def closing(text: str, opening: int) -> int:
    """The place of the bracket that closes the one at `opening`, strings skipped; the end of the text if none does."""
    depth, i = 0, opening
    while i < len(text):
        c = text[i]
        if c in "\"'`":
            m = re.compile(rf"(?:\\.|[^\\{c}])*{c}", re.S).match(text, i + 1)
            i = m.end() if m else i + 1
            continue
        depth += (c in "([{") - (c in ")]}")
        if depth == 0:
            return i
        i += 1
    return len(text)


def arguments(text: str, opening: int) -> tuple[list[str], int]:
    """The arguments of the call whose bracket opens there, and the place behind the call."""
    end = closing(text, opening)
    out, at, i = [], opening + 1, opening + 1
    while i < end:
        c = text[i]
        if c in "\"'`([{":
            if c in "([{":
                i = closing(text, i) + 1
            else:
                m = re.compile(rf"(?:\\.|[^\\{c}])*{c}", re.S).match(text, i + 1)
                i = m.end() if m else i + 1
            continue
        if c == ",":
            out.append(text[at:i].strip())
            at = i + 1
        i += 1
    out.append(text[at:end].strip())
    return [a for a in out if a], end + 1


def literal(argument: str) -> str | None:
    m = re.fullmatch(_STRING, argument)
    return next((g for g in m.groups() if g is not None), "") if m else None


def imports(text: str) -> dict[str, tuple[str, str]]:
    """Each imported name with its module and what the module calls it; `default` for the whole or the default."""
    out: dict[str, tuple[str, str]] = {}

    def several(names: str | None, module: str, word: str) -> None:
        for name in (names or "").split(","):
            m = re.fullmatch(rf"\s*(?:type\s+)?(\w+)(?:\s*{word}\s*(\w+))?\s*", name)
            if m:
                out[m[2] or m[1]] = module, m[1]

    for m in _IMPORT.finditer(text):
        if m[1]:
            out[m[1]] = m[3], "default"
        several(m[2], m[3], r"(?:\bas\b)")
    for m in _REQUIRE.finditer(text):
        if m[1]:
            out[m[1]] = m[3], m[4] or "default"
        several(m[2], m[3], ":")
    return out


# --- routers --------------------------------------------------------------------------------------------------------


def _taker_scopes(text: str, wanted: set[str]) -> list[tuple[int, int, str, str]]:
    """(start, end, parameter, name) of the named functions that take an instance as their first parameter."""
    out = []
    for m in _TAKER.finditer(text):
        name, parameter = m[1] or m[3], m[2] or m[4]
        if name in wanted:
            opening = text.find("{", closing(text, text.index("(", m.start())))
            if opening >= 0:
                out.append((opening, closing(text, opening), parameter, name))
    return out


def _receivers(text: str, known: dict[str, tuple[str, str]]) -> tuple[dict[str, str], dict[str, str]]:
    """Applications and routers that factories make, each with its framework."""
    applications, routers = {}, {}
    for name, factory, part in _MADE.findall(text):
        module, what = known.get(factory, ("", ""))
        if module == "express" and what == "default" and not part:
            applications[name] = "express"
        elif module == "express" and (part == "Router" and what == "default" or what == "Router" and not part):
            routers[name] = "express"
        elif module == "fastify" and what in ("default", "fastify") and not part:
            applications[name] = "fastify"
    return applications, routers


def _exports(text: str) -> dict[str, str]:
    """Exported names with the local ones that they stand for."""
    out = {m[1]: m[1] for m in re.finditer(r"\bexport\s+(?:async\s+)?(?:const|let|var|function)\s+(\w+)", text)}
    for m in re.finditer(r"\bexport\s+default\s+(?:async\s+)?(?:function\s+)?(\w+)|\bmodule\.exports\s*=\s*(\w+)\s*(?:;|$)", text, re.M):
        out["default"] = m[1] or m[2]
    for m in re.finditer(r"\bexport\s*\{([^}]*)\}(?!\s*from)|\bmodule\.exports\s*=\s*\{([^}:]*)\}", text):
        for name in (m[1] or m[2]).split(","):
            if pair := re.fullmatch(r"\s*(\w+)(?:\s+as\s+(\w+))?\s*", name):
                out[pair[2] or pair[1]] = pair[1]
    return out


def facts_in(path: str, text: str) -> Iterator[Fact]:
    """Facts of one file without comments."""
    known = imports(text)
    yield from controllers(text, known)
    applications, routers = _receivers(text, known)
    exported = _exports(text)
    plugins = {a for m in re.finditer(r"\.register\s*\(\s*(\w+)", text) for a in [m[1]]} | set(exported.values())
    scopes = _taker_scopes(text, plugins)
    node = lambda name: f"{path}#{name}"

    def receiver(name: str, at: int) -> str | None:
        inside = [s for s in scopes if s[0] <= at < s[1] and s[2] == name]
        if inside:
            return max(inside)[3]
        return name if name in applications or name in routers else None

    for name, framework in (applications | routers).items():
        yield "router", 1, 1, {"node": node(name), "root": str(name in applications).lower(), "framework": framework}
    for _, _, _, name in scopes:
        yield "router", 1, 1, {"node": node(name), "root": "false", "framework": "fastify"}
    for m in _ON.finditer(text):
        on = receiver(m[1], m.start())
        if on is None:
            continue
        given, end = arguments(text, m.end() - 1)
        first, last = line_at(text, m.start()), line_at(text, end)
        if m[2] in ("use", "register"):
            yield from _mounts(node, on, m[2], given, known, {*applications, *routers, *(s[3] for s in scopes)}, path, first, last)
        elif m[2] == "route":
            yield from _chain_or_object(text, node(on), given, first, end)
        elif len(given) > 1 and (route := literal(given[0])) is not None:
            yield from _route(node(on), m[2], route, given[1:], first, last)
    # What others may import of this file.
    local = {*applications, *routers, *(s[3] for s in scopes)}
    for name, own in exported.items():
        if own in local:
            yield "route_export", 1, 1, {"module": re.sub(r"/index$", "", re.sub(ENDINGS, "", path)), "name": name, "node": node(own)}


def _mounts(node, on: str, how: str, given: list[str], known: dict, local: set[str], path: str, first: int, last: int) -> Iterator[Fact]:
    if not given:
        return
    prefix, names = "", given
    if how == "use":
        if (prefix := literal(given[0])) is not None:
            names = given[1:]
        elif _NAME.fullmatch(given[0]):
            prefix = ""
        else:
            return
        child = names[-1] if names else ""
    else:
        child = given[0]
        if len(given) > 1:
            m = re.search(rf"\bprefix\s*:\s*(?:{_STRING})", given[1])
            if not m and "prefix" in given[1] or not given[1].startswith("{"):
                return
            prefix = next((g for g in m.groups() if g is not None), "") if m else ""
    if child in local:
        yield "mount", first, last, {"parent": node(on), "prefix": prefix, "child": node(child)}
    elif child in known and known[child][0].startswith("."):
        module = posixpath.normpath(posixpath.join(posixpath.dirname(path), known[child][0]))
        yield "mount", first, last, {"parent": node(on), "prefix": prefix, "module": re.sub(r"/index$", "", re.sub(ENDINGS, "", module)), "name": known[child][1]}


def _route(on: str, method: str, route: str, handlers: list[str], first: int, last: int) -> Iterator[Fact]:
    handler = handlers[-1]
    symbol = handler if re.fullmatch(r"[\w$]+(\.[\w$]+)*", handler) else (re.match(r"(?:async\s+)?function\s+(\w+)", handler) or ["", f"{method.upper()} {route}"])[1]
    between = [{"symbol": h} for h in handlers[:-1] if _NAME.fullmatch(h)]
    contract = json.dumps({"route_middlewares": between}) if between else ""
    yield "route", first, last, {"receiver": on, "method": method.upper(), "path": route, "symbol": symbol, "contract": contract}


def _chain_or_object(text: str, on: str, given: list[str], first: int, end: int) -> Iterator[Fact]:
    """`route(path).get(f).post(g)`, or `route({ method, url, handler })`."""
    if len(given) != 1:
        return
    route = literal(given[0])
    if route is not None:
        while m := _THEN.match(text, end):
            handlers, end = arguments(text, m.end() - 1)
            if m[1] in METHODS and handlers:
                yield from _route(on, m[1], route, handlers, first, line_at(text, end))
        return
    if not given[0].startswith("{"):
        return
    fields: dict[str, list[str]] = {}
    for pair in arguments(given[0], 0)[0]:
        key, colon, value = pair.partition(":")
        fields.setdefault(key.strip().strip("'\""), []).append(value.strip() if colon else key.strip())
    if any(len(fields.get(k, [])) != 1 for k in ("method", "url", "handler")):
        return
    method, url, handler = fields["method"][0], literal(fields["url"][0]), fields["handler"][0]
    methods = [literal(x) for x in (arguments(method, 0)[0] if method.startswith("[") else [method])]
    if url is None or not methods or any(x is None or x.lower() not in METHODS for x in methods) or len({x.upper() for x in methods}) < len(methods):
        return
    for x in methods:
        yield from _route(on, x.lower(), url, [handler], first, line_at(text, end))


# --- controllers ----------------------------------------------------------------------------------------------------


def _decorators(text: str, known: dict[str, tuple[str, str]]) -> list[tuple[str, str, list[str] | None]]:
    """(module, name, arguments) of imported decorators that are called."""
    out = []
    for m in _DECORATOR.finditer(text):
        if m[1] in known and m[2]:
            out.append((*known[m[1]], arguments(m[2], 0)[0]))
    return out


def controllers(text: str, known: dict[str, tuple[str, str]]) -> Iterator[Fact]:
    if not any(module == "@nestjs/common" and name == "Controller" for module, name in known.values()):
        return
    common = lambda found: [(name, given) for module, name, given in found if module == "@nestjs/common"]
    for c in _CLASS.finditer(text):
        above = _decorators(c[1], known)
        places = [given for name, given in common(above) if name == "Controller"]
        opening = text.find("{", c.end())
        if len(places) != 1 or opening < 0 or len(places[0]) > 1:
            continue
        prefix = literal(places[0][0]) if places[0] else ""
        if prefix is None:
            continue
        end = closing(text, opening)
        for m in _METHOD.finditer(text, opening, end):
            own = _decorators(m[1], known)
            verbs = [(CONTROLLER_METHODS[name], given) for name, given in common(own) if name in CONTROLLER_METHODS]
            if len(verbs) != 1 or len(verbs[0][1]) > 1:
                continue
            route = literal(verbs[0][1][0]) if verbs[0][1] else ""
            if route is None:
                continue
            parameters, behind = arguments(text, m.end() - 1)
            contract = _contract([(above, "controller"), (own, "handler")], parameters, known)
            name = re.sub("/+", "/", f"/{prefix}/{route}").rstrip("/") or "/"
            body = text.find("{", behind)
            fields = {"transport": "http", "method": verbs[0][0], "name": name, "symbol": f"{c[2]}.{m[2]}"}
            yield "entrypoint", line_at(text, m.start()), line_at(text, closing(text, body) if body >= 0 else behind), fields | {"contract": json.dumps(contract, sort_keys=True) if contract else ""}


def _contract(levels: list[tuple[list, str]], parameters: list[str], known: dict[str, tuple[str, str]]) -> dict:
    out: dict = {}
    for found, scope in levels:
        for module, name, given in found:
            if module == "@nestjs/common" and name in REGISTRATIONS:
                out.setdefault(REGISTRATIONS[name], []).extend({"symbol": g, "scope": scope} for g in given if _NAME.fullmatch(g))
            elif (module, name) in OTHER_DECORATORS:
                out.setdefault(OTHER_DECORATORS[module, name], []).append({"decorator": name, "scope": scope})
    bodies, bound = [], []
    for parameter in parameters:
        heads = list(_DECORATOR.finditer(parameter))
        rest = _PARAMETER.fullmatch(parameter[heads[-1].end() :]) if heads else None
        if not rest:
            continue
        required = not rest[2] and not rest[4]
        own = [(name, given) for module, name, given in _decorators(parameter[: heads[-1].end()], known) if module == "@nestjs/common"]
        if any(name == "Body" and not given for name, given in own):
            bodies.append({"name": rest[1], "type": rest[3], "required": required})
        told = [(BINDINGS[name], literal(given[0])) for name, given in own if name in BINDINGS and len(given) == 1 and literal(given[0]) is not None]
        if len(told) == 1:
            bound.append({"kind": told[0][0], "name": told[0][1], "variable": rest[1], "type": rest[3], "required": told[0][0] == "path" or required})
    if len(bodies) == 1:
        out["request"] = bodies[0]
    if bound:
        out["parameters"] = bound
    return {k: v for k, v in out.items() if v}


# --- tables ---------------------------------------------------------------------------------------------------------


def composed(facts: DataFrame) -> DataFrame:
    """The same facts with an entrypoint for each route of a router that hangs in one place; what served to find these goes.

    Facts are read several times: they should come from a written table.
    """
    field = lambda name: F.col("fields")[name].alias(name)
    kind = lambda name: facts.filter(F.col("kind") == name)
    exports = kind("route_export").select(field("module"), field("name"), field("node"))
    only = exports.groupBy("module", "name").agg(F.min("node").alias("child"), F.max("node").alias("_other")).filter("child = _other").drop("_other")
    mounts = kind("mount").select(field("parent"), field("prefix"), field("child"), field("module"), field("name"))
    near = mounts.filter("child IS NOT NULL").select("parent", "prefix", "child")
    far = mounts.filter("child IS NULL").drop("child").join(only, ["module", "name"]).select("parent", "prefix", "child")
    roots = kind("router").filter(F.col("fields")["root"] == "true").select(field("node"))
    places = paths.mounted(near.unionByName(far), roots)
    routes = kind("route").select("path", "start_line", "end_line", field("receiver"), field("method"), F.col("fields")["path"].alias("own"), field("symbol"), field("contract"))
    found = paths.composed_routes(routes, places, path="own")
    pairs = {"transport": F.lit("http"), "method": F.col("method"), "name": F.col("route"), "symbol": F.col("symbol"), "contract": F.col("contract")}
    fields = F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values()))
    entrypoints = found.select(F.lit("entrypoint").alias("kind"), "path", "start_line", "end_line", fields.alias("fields"))
    return facts.filter(~F.col("kind").isin(*KINDS)).unionByName(entrypoints)
