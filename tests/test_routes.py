"""Routes of Node applications, and the operators on paths, against hand-made cases and brute force."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from latticework.operators import paths
from latticework.sources import extract, routes
from tests.conftest import rows

EXPRESS = 'import express from "express";\nconst app = express();\n'
HANDLER = "function createOrder(req: Request, res: Response) {\n  return orderService.create(req.body);\n}\n"
NEST = 'import { Body, Controller, Get, Headers, Param, Post, Query, UseGuards, UsePipes } from "@nestjs/common";\n'
CASES = {
    "plain.ts": (EXPRESS + HANDLER + 'app.post("/orders", createOrder);', [("POST", "/orders", "createOrder", None)]),
    "old.js": ('const web = require("express");\nvar app = web();\napp.get("/a", function list(req, res) {});', [("GET", "/a", "list", None)]),
    "setting.ts": (EXPRESS + 'app.get("env");\napp.get(name, createOrder);\nclient.get("/x", createOrder);', []),
    "middle.ts": (
        EXPRESS + 'app.post("/orders", requireLogin, limit(5), validateOrder, createOrder);',
        [("POST", "/orders", "createOrder", {"route_middlewares": [{"symbol": "requireLogin"}, {"symbol": "validateOrder"}]})],
    ),
    "head.ts": (EXPRESS + 'app.head("/health", check);\napp.options("/health", check);', [("HEAD", "/health", "check", None), ("OPTIONS", "/health", "check", None)]),
    "inline.ts": (EXPRESS + 'app.post("/orders", async (req, res) => { return service.create({ a: "),(" }); });', [("POST", "/orders", "POST /orders", None)]),
    "chain.ts": (EXPRESS + 'app.route("/orders")\n  .get(list)\n  .post(check, createOrder);', [("GET", "/orders", "list", None), ("POST", "/orders", "createOrder", {"route_middlewares": [{"symbol": "check"}]})]),
    "mount.ts": (EXPRESS + 'const router = express.Router();\napp.use("/api", router);\nrouter.post("/orders", createOrder);', [("POST", "/api/orders", "createOrder", None)]),
    "free.ts": ('import express from "express";\nconst router = express.Router();\nrouter.post("/orders", createOrder);', []),
    "twice.ts": (EXPRESS + 'const router = express.Router();\napp.use("/api", router);\napp.use("/internal", router);\nrouter.post("/orders", createOrder);', []),
    "nested.ts": (
        'import express, { Router } from "express";\nconst app = express();\nconst api = Router();\nconst v1: Router = express.Router();\nconst items = Router();\n'
        'app.use("/api/", auth, api);\napi.use("/v1", v1);\nv1.use(items);\nitems.get("/", list);\nitems.get("/:id/", find);\nitems.use(logger);',
        [("GET", "/api/v1", "list", None), ("GET", "/api/v1/:id", "find", None)],
    ),
    "cycle.ts": (EXPRESS + 'const a = express.Router();\nconst b = express.Router();\na.use("/b", b);\nb.use("/a", a);\na.get("/x", f);\nb.get("/y", g);', []),
    "named.ts": (EXPRESS + 'import { orders as shop } from "./shop/orders";\nimport users from "./shop/users";\napp.use("/shop", shop);\napp.use("/users", users);', []),
    "shop/orders.ts": ('import { Router } from "express";\nexport const orders = Router();\norders.get("/:id", find);', [("GET", "/shop/:id", "find", None)]),
    "shop/users/index.js": ('const { Router } = require("express");\nconst r = Router();\nr.delete("/:id", drop);\nmodule.exports = r;', [("DELETE", "/users/:id", "drop", None)]),
    "fast.ts": ('import Fastify from "fastify";\nconst app = Fastify();\napp.post("/orders", createOrder);', [("POST", "/orders", "createOrder", None)]),
    "unproven.ts": ('const app = makeTestServer();\napp.post("/orders", createOrder);', []),
    "object.ts": ('import Fastify from "fastify";\nconst app = Fastify();\napp.route({ method: ["GET", "HEAD"], url: "/orders/:id", handler: readOrder });', [("GET", "/orders/:id", "readOrder", None), ("HEAD", "/orders/:id", "readOrder", None)]),
    "dynamic.ts": ('import Fastify from "fastify";\nconst app = Fastify();\nconst url = "/orders";\napp.route({ method: "POST", url: url, handler: f });\napp.route({ method: "POST", method: "PUT", url: "/a", handler: f });\napp.route({ method: verb, url: "/a", handler: f });', []),
    "plugin.ts": (
        'import Fastify from "fastify";\nconst app = Fastify();\nasync function orders(instance, options) {\n  instance.get("/", list);\n  instance.register(items, { prefix: "/items" });\n}\n'
        'const items = async (web) => {\n  web.post("/", add);\n};\napp.register(orders, { prefix: "/orders" });\napp.register(other, { prefix: base });',
        [("GET", "/orders", "list", None), ("POST", "/orders/items", "add", None)],
    ),
    "nest.ts": (
        NEST + '@Controller("/orders")\n@UseGuards(AuthenticationGuard)\n@UsePipes(ValidationPipe)\nexport class Orders {\n  @Post()\n  @UseGuards(Permission, make())\n  @UsePipes(new Pipe({ a: f(1) }))\n  create(@Body() input: CreateOrderDto) {\n    return this.orderService.create(input);\n  }\n'
        '  @Get(":id")\n  async find(\n    @Param("id") id: string,\n    @Query("all") all?: boolean,\n    @Headers("x-request-id") requestId: RequestId,\n    @Query() rest: Rest,\n  ) {}\n}',
        [
            ("POST", "/orders", "Orders.create", {"request": {"name": "input", "type": "CreateOrderDto", "required": True}, "route_guards": [{"symbol": "AuthenticationGuard", "scope": "controller"}, {"symbol": "Permission", "scope": "handler"}], "validation_pipes": [{"symbol": "ValidationPipe", "scope": "controller"}]}),
            ("GET", "/orders/:id", "Orders.find", {
                "parameters": [{"kind": "path", "name": "id", "variable": "id", "type": "string", "required": True}, {"kind": "query", "name": "all", "variable": "all", "type": "boolean", "required": False}, {"kind": "header", "name": "x-request-id", "variable": "requestId", "type": "RequestId", "required": True}],
                "route_guards": [{"symbol": "AuthenticationGuard", "scope": "controller"}], "validation_pipes": [{"symbol": "ValidationPipe", "scope": "controller"}],
            }),
        ],
    ),
    "cache.ts": (
        'import { CacheKey, CacheTTL } from "@nestjs/cache-manager";\nimport { Controller, Post } from "@nestjs/common";\nimport { Throttle } from "@nestjs/throttler";\n@Controller("/orders")\n@CacheTTL(60000)\n@Throttle()\nexport class A {\n  @Post()\n  @CacheKey("orders.create")\n  @Throttle()\n  create(input: CreateOrder) {}\n}',
        [("POST", "/orders", "A.create", {"cache_decorators": [{"decorator": "CacheTTL", "scope": "controller"}, {"decorator": "CacheKey", "scope": "handler"}], "rate_limit_decorators": [{"decorator": "Throttle", "scope": "controller"}, {"decorator": "Throttle", "scope": "handler"}]})],
    ),
    "local.ts": ('import { Controller, Post } from "@nestjs/common";\nimport { CacheTTL, Throttle } from "./local";\n@Controller("/orders")\n@CacheTTL(60000)\nexport class B {\n  @Post()\n  @Throttle()\n  create(input: CreateOrder) {}\n}', [("POST", "/orders", "B.create", None)]),
    "fake.ts": ('import { Controller, Post } from "./own";\n@Controller("/orders")\nexport class C {\n  @Post()\n  create() {}\n}', []),
    "computed.ts": ('import { Controller, Post } from "@nestjs/common";\n@Controller(PREFIX)\nexport class D {\n  @Post()\n  create() {}\n}', []),
}


def test_routes(spark):
    files = spark.createDataFrame([(p, t) for p, (t, _) in CASES.items()], "path string, text string")
    found = {p: [] for p in CASES}
    facts = extract.extract(files)
    assert not {r["kind"] for r in facts.select("kind").distinct().collect()} & {"router", "mount", "route", "route_export"}
    for r in facts.filter("kind = 'entrypoint'").collect():
        f = r["fields"]
        assert f["transport"] == "http"
        found[r["path"]].append((f["method"], f["name"], f["symbol"], json.loads(f["contract"]) if f["contract"] else None))
    for path, (_, want) in CASES.items():
        assert sorted(found[path], key=str) == sorted(want, key=str), path


def test_literals_and_arguments():
    assert routes.literal("`/a`") == "/a" and routes.literal("`/${a}`") is None and routes.literal("a") is None and routes.literal("''") == ""
    assert routes.arguments('f(a, { b: [1, 2] }, "x,)", (p, q) => g(p, q))', 1)[0] == ["a", "{ b: [1, 2] }", '"x,)"', "(p, q) => g(p, q)"]
    assert routes.imports('import a, { b as c, type D } from "m";\nimport * as e from "n";\nconst { f: g, h } = require("o");\nconst i = require("p").q;') == {"a": ("m", "default"), "c": ("m", "b"), "D": ("m", "D"), "e": ("n", "default"), "g": ("o", "f"), "h": ("o", "h"), "i": ("p", "q")}


# --- operators ------------------------------------------------------------------------------------------------------


def test_mounts_equal_brute_force(spark):
    r = random.Random(7)
    ways = [(f"n{r.randrange(i)}" if i else "n0", f"n{i + 1}", f"/p{i}") for i in range(300)]
    ways += [(f"c{i}", f"c{(i + 1) % 40}", "/c") for i in range(40)] + [("c3", "under", "/u"), ("n5", "n9", "/again"), ("nowhere", "lost", "/l"), ("self", "self", "/s"), (None, "n1", "/x"), ("n2", None, "/x"), ("n0", "bare", None)]
    ways += [(f"d{i}", f"d{i + 1}", "/d") for i in range(150)] + [("n0", "d0", ""), ways[20]]
    got = {x["node"]: (x["root"], x["prefix"], x["depth"]) for x in paths.mounted(spark.createDataFrame(ways, "parent string, child string, prefix string"), spark.createDataFrame([("n0",), ("n0",), ("alone",), (None,)], "node string")).collect()}
    up = {}
    for a, b, p in set(ways):
        if a is not None and b is not None:
            up.setdefault(b, set()).add((a, p or ""))
    want = {}
    for node in {"n0", "alone", *up}:
        at, prefix, depth = node, "", 0
        while at not in ("n0", "alone") and len(up.get(at, ())) == 1 and depth < 1000:
            (at, p), depth = next(iter(up[at])), depth + 1
            prefix = p + prefix
        if at in ("n0", "alone"):
            want[node] = (at, prefix, depth)
    assert got == want and want["d150"][2] == 151 and "under" not in want
    assert paths.mounted(spark.createDataFrame([], "parent string, child string, prefix string"), spark.createDataFrame([], "node string")).count() == 0


def test_joined_routes(spark):
    df = spark.createDataFrame([("", ""), ("", "/"), ("/api/", "/orders/"), ("api", "orders"), ("/a//b", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(paths.joined_route(F.col("a"), F.col("b"))).collect()] == ["/", "/", "/api/orders", "/api/orders", "/a/b", "/"]


def test_templates_equal_brute_force(spark):
    r = random.Random(8)
    words = ["a", "b", "7", "{x}", ":y", "<z>", "*"]
    make = lambda words: "/" + "/".join(r.choice(words) for _ in range(r.randint(0, 4)))
    endpoints = sorted({(r.choice("st"), make(words)) for _ in range(200)})
    calls = [(i, r.choice("st"), make(["a", "b", "7", "9", "{own}"]) + r.choice(["", "/", "?q=1", "#f"])) for i in range(300)] + [(300, "s", None), (301, None, "/a")]
    is_open = lambda s: bool(re.match(paths.PARAMETER, s))
    parts = lambda p: [s for s in re.sub(r"[?#].*$", "", p).split("/") if s]
    every, best = set(), set()
    for i, service, path in calls:
        fits = []
        for s, t in endpoints:
            if path is not None and s == service and len(parts(path)) == len(parts(t)) and all(is_open(b) or (a == b and not is_open(a)) for a, b in zip(parts(path), parts(t), strict=True)):
                fits.append(("".join("p" if is_open(x) else "l" for x in parts(t)), t))
        every |= {(i, t) for _, t in fits}
        best |= {(i, t) for k, t in fits if k == min(fits)[0]}
    c = spark.createDataFrame(calls, "id int, service string, path string")
    e = spark.createDataFrame(endpoints, "service string, template string")
    assert set(rows(paths.matched_templates(c, e, ["service"], best_only=False), "id", "template")) == every
    assert set(rows(paths.matched_templates(c, e, ["service"]), "id", "template")) == best and len(best) > 50
    assert paths.matched_templates(c, e.limit(0), ["service"]).count() == 0


def topic_fits(key, pattern):
    if not pattern:
        return not key
    if pattern[0] == "#":
        return any(topic_fits(key[i:], pattern[1:]) for i in range(len(key) + 1))
    return bool(key) and (pattern[0] in ("*", key[0])) and topic_fits(key[1:], pattern[1:])


def test_topics_equal_brute_force(spark):
    r = random.Random(9)
    make = lambda words, most: ".".join(r.choice(words) for _ in range(r.randint(1, most)))
    keys = [(i, r.choice("ef"), make(["a", "b", "c+(", "", "E\\"], 5)) for i in range(250)] + [(250, "e", None)]
    patterns = sorted({(r.choice("ef"), make(["a", "b", "c+(", "*", "#", "#", "", "E\\"], 5)) for _ in range(250)}) + [("e", None)]
    want = {(i, p) for i, x, k in keys for y, p in patterns if x == y and k is not None and p is not None and topic_fits(k.split("."), p.split("."))}
    got = rows(paths.matched_topics(spark.createDataFrame(keys, "id int, exchange string, routing_key string"), spark.createDataFrame(patterns, "exchange string, pattern string"), ["exchange"]), "id", "pattern")
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_runs_between_open_ends_are_looked_up(spark, monkeypatch):
    """With an expression that takes all, what is left to try is what the lookup gives: not every key with every pattern."""
    monkeypatch.setattr(paths, "_topic_regex", lambda pattern: F.lit(""))
    keys = spark.range(300).selectExpr("id", "'e' AS exchange", "concat('order.', id % 5, '.', id, '.1997') AS routing_key")
    patterns = spark.range(300).selectExpr("id AS bound", "'e' AS exchange", "concat('#.order.*.', id, '.#') AS pattern")
    assert rows(paths.matched_topics(keys, patterns, ["exchange"]), "id", "bound") == sorted(((i, i) for i in range(300)), key=str)


@pytest.mark.parametrize("left", [False, True])
def test_innermost_equals_brute_force(spark, left):
    r = random.Random(10)
    ranges = [(r.choice("fg"), s, s + r.choice([0, 1, 5, 30, 200]), f"d{r.randrange(9)}") for s in (r.randrange(300) for _ in range(200))]
    ranges += [("f", 0, 2**31 - 1, "all"), ("f", 5, 4, "empty"), ("g", None, 4, "null"), (None, 1, 9, "nofile"), ("g", -5, 3, "below")]
    points = [(i, r.choice("fgh"), r.randrange(600)) for i in range(300)] + [(300, "f", 2**31 - 1), (301, "f", None), (302, None, 3)]
    want = set()
    for i, file, line in points:
        held = [(e - s, -s, n) for f, s, e, n in ranges if f is not None and f == file and s is not None and line is not None and 0 <= s <= line <= e]
        if held:
            length, later, name = min(held)
            want.add((i, name, -later, length - later))
        elif left:
            want.add((i, None, None, None))
    got = paths.innermost(spark.createDataFrame(points, "id int, file string, line long"), spark.createDataFrame(ranges, "file string, start_line long, end_line long, name string"), ["file"], left=left)
    assert got.count() == len(want) and set(rows(got, "id", "name", "start_line", "end_line")) == want
