"""What calls mean, by the declared type of what they are called on; remote calls by generated stubs and declared clients.

Each file is read once for what it declares: typed members of classes, typed parameters, repositories with their queries,
generated server bases and client stubs, declared HTTP clients, and the fields of data types. All else are joins of the calls
(flow edges) with these declarations and with a table of operations: a call is a read or a write if its receiver is declared
in the same class or function with a type of some family, and the family's table has its method. Nothing is guessed from names
of receivers. Where a declaration is not unique, nothing is linked.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import nesting
from latticework.sources import extract
from latticework.sources.extract import Fact, block_end, line_at, without_comments
from latticework.sources.folders import workers_find_us

# Operations by the family of their receiver, as the libraries name them.
OPERATIONS: dict[str, dict[str, list[str]]] = {
    "mongoose": {
        "reads": ["aggregate", "countdocuments", "distinct", "estimateddocumentcount", "exists", "find", "findbyid", "findone"],
        "writes": ["bulkwrite", "create", "deletemany", "deleteone", "findbyidanddelete", "findbyidandupdate", "findoneanddelete", "findoneandupdate", "insertmany", "replaceone", "updatemany", "updateone"],
    },
    "prisma": {
        "reads": ["aggregate", "count", "findfirst", "findfirstorthrow", "findmany", "findunique", "finduniqueorthrow", "groupby"],
        "writes": ["create", "createmany", "createmanyandreturn", "delete", "deletemany", "deletemanyandreturn", "update", "updatemany", "updatemanyandreturn", "upsert"],
    },
    "gorm": {
        "reads": ["count", "find", "findinbatches", "first", "last", "pluck", "row", "rows", "scan", "take"],
        "writes": ["create", "delete", "exec", "save", "update", "updatecolumn", "updatecolumns", "updates"],
    },
    "sql": {"reads": ["query", "querycontext", "queryrow", "queryrowcontext"], "writes": ["exec", "execcontext"]},
    "repository": {
        "reads": ["count", "existsbyid", "findall", "findallbyid", "findbyid", "getbyid", "getone", "getreferencebyid"],
        "writes": ["delete", "deleteall", "deleteallbyid", "deleteallbyidinbatch", "deleteallinbatch", "deletebyid", "deleteinbatch", "flush", "save", "saveall", "saveandflush"],
    },
    "jdbc": {"reads": [], "writes": ["update", "batchupdate"]},
    "mongo": {
        "reads": ["aggregate", "count", "distinct", "exists", "find", "findbyid", "findone"],
        "writes": ["findandmodify", "findandreplace", "insert", "insertall", "remove", "save", "updatefirst", "updatemulti", "upsert"],
    },
    "entity_manager": {"reads": ["find", "getreference"], "writes": ["flush", "merge", "persist", "remove"]},
}
# Types that tell a family, and beginnings of derived queries.
FAMILIES = {"JdbcTemplate": "jdbc", "NamedParameterJdbcTemplate": "jdbc", "MongoTemplate": "mongo", "ReactiveMongoTemplate": "mongo", "EntityManager": "entity_manager"}
REPOSITORY_BASES = ["CrudRepository", "JpaRepository", "ListCrudRepository", "ListPagingAndSortingRepository", "MongoRepository", "PagingAndSortingRepository", "ReactiveCrudRepository", "ReactiveMongoRepository"]
DERIVED_READS = ["countBy", "existsBy", "findBy", "getBy", "queryBy", "readBy", "streamBy"]
DERIVED_WRITES = ["deleteBy", "removeBy"]
VALIDATIONS = ["NotNull", "NotBlank", "NotEmpty", "Positive", "Negative", "Size", "Pattern"]

_CLASS = re.compile(r"\b(?:class|interface)\s+(\w+)")
_JAVA_MEMBER = re.compile(r"^\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:private|protected|public|final|static|lateinit)\s+)+([A-Z][\w.]*)(?:<[^>;]*>)?\s+(\w+)\s*(?:=[^;]*)?;", re.M)
_KOTLIN_MEMBER = re.compile(r"\b(?:val|var)\s+(\w+)\s*:\s*([A-Z][\w.]*)")
_REPOSITORY = re.compile(r"\binterface\s+(\w+)\s*(?:extends|:)\s*([^{]+)\{")
_QUERY = re.compile(r"@Query\s*\((?:[^()]|\([^()]*\))*\)\s*((?:@\w+(?:\s*\([^)]*\))?\s*)*)(?:(?:public|suspend|fun)\s+)*(?:[\w.<>,?\[\]]+\s+)?(\w+)\s*\(")
_FEIGN = re.compile(r"@FeignClient\s*\(\s*(?:name|value)\s*=\s*\"([^\"$]+)\"[^)]*\)\s*((?:@\w+(?:\s*\([^)]*\))?\s*)*)(?:public\s+)?interface\s+(\w+)\s*\{")
_MAPPED = re.compile(r"@(Get|Post|Put|Patch|Delete)Mapping\s*\(\s*(?:(?:value|path)\s*=\s*)?\"([^\"$]+)\"[^)]*\)\s*(?:fun\s+)?(?:[\w<>?,\[\]. ]+\s)?(\w+)\s*\(")
_PREFIX = re.compile(r"@RequestMapping\s*\(\s*(?:(?:value|path)\s*=\s*)?\"([^\"$]*)\"")
_SERVER = re.compile(r"(?:\bextends\s+|:\s*)(?:[\w.]+\.)?(\w+?)Grpc(?:Kt)?\.\w*ImplBase\b")
_STUB = re.compile(r"\b(\w+?)Grpc(?:Kt)?\.\w*Stub\s+(\w+)\b|\b(?:val|var)\s+(\w+)\s*:\s*(?:\w+\.)*?(\w+?)Grpc(?:Kt)?\.\w*Stub\b")


def _blocks(text: str, pattern: re.Pattern) -> Iterator[tuple[re.Match, str, int]]:
    """Matches with the block in braces that follows each, and where it starts."""
    for m in pattern.finditer(text):
        opening = text.find("{", m.end() - 1)
        if opening >= 0:
            yield m, text[opening + 1 : block_end(text, opening) - 1], opening + 1


def _jvm(text: str) -> Iterator[Fact]:
    def at(m: re.Match, shift: int = 0) -> tuple[int, int]:
        return line_at(text, shift + m.start()), line_at(text, shift + m.end())

    for c, body, begin in _blocks(text, _CLASS):
        head = text[c.start() : begin]
        members = [(m[2], m[1], m, begin) for m in _JAVA_MEMBER.finditer(body)] + [(m[1], m[2], m, begin) for m in _KOTLIN_MEMBER.finditer(body)] + [(m[1], m[2], m, c.start()) for m in _KOTLIN_MEMBER.finditer(head)]
        for name, kind, m, shift in members:
            yield "member", *at(m, shift), {"owner": c[1], "name": name, "type": kind.rsplit(".", 1)[-1]}
        if (server := _SERVER.search(head)) and "@GrpcService" in text[max(0, text.rfind("}", 0, c.start())) : c.start()]:
            for m in re.finditer(r"(?:@Override\s+(?:public\s+)?[\w<>.,? ]+?|\boverride\s+(?:suspend\s+)?fun)\s+(\w+)\s*\(", body):
                yield "grpc_handler", *at(m, begin), {"service": server[1], "method": m[1], "symbol": f"{c[1]}.{m[1]}"}
        for m in _STUB.finditer(body):
            yield "grpc_client", *at(m, begin), {"owner": c[1], "member": m[2] or m[3], "service": m[1] or m[4]}
        fields = [{"name": m[3], "type": m[2], "validations": re.findall("|".join(VALIDATIONS), m[1]), "required": bool(re.search("|".join(VALIDATIONS), m[1]))} for m in re.finditer(r"((?:@\w+(?:\([^)]*\))?\s*)*)(?:(?:private|protected|public|final)\s+)*([A-Z]\w*(?:<[^>]+>)?)\s+(\w+)\s*;", body)]
        if fields:
            yield "shape", *at(c), {"name": c[1], "shape": json.dumps(fields)}
    for r, body, begin in _blocks(text, _REPOSITORY):
        if any(re.search(rf"\b{b}\b", r[2]) for b in REPOSITORY_BASES):
            yield "repository", *at(r), {"name": r[1]}
            for m in _QUERY.finditer(body):
                yield "query_method", *at(m, begin), {"repository": r[1], "method": m[2], "operation": "writes" if "@Modifying" in m[1] else "reads"}
    for f, body, begin in _blocks(text, _FEIGN):
        prefix = _PREFIX.search(f[2])
        for m in _MAPPED.finditer(body):
            yield "remote_method", *at(m, begin), {"client": f[3], "service": f[1], "method": m[3], "verb": m[1].upper(), "path": extract.joined_route(prefix[1] if prefix else "", m[2])}


def _go(text: str) -> Iterator[Fact]:
    for m in re.finditer(r"^func\s+(?:\(\s*\w+\s+\*?(\w+)\s*\)\s*)?(\w+)\s*\(", text, re.M):
        symbol, close = f"{m[1]}.{m[2]}" if m[1] else m[2], block_end(text, m.end() - 1, "()")
        for p in re.finditer(r"\b(\w+)\s+\*(gorm\.DB|sql\.DB|sql\.Tx)\b", text[m.end() : close]):
            yield "parameter", line_at(text, m.start()), line_at(text, close), {"symbol": symbol, "name": p[1], "family": "gorm" if p[2][0] == "g" else "sql"}
    bases = {}
    for s, body, begin in _blocks(text, re.compile(r"\btype\s+(\w+)\s+struct\b")):
        embedded = re.findall(r"^\s*(?:\w+\.)?Unimplemented(\w+)Server\s*$", body, re.M)
        if len(embedded) == 1:
            bases[s[1]] = embedded[0]
        for m in re.finditer(r"^\s*(\w+)\s+(?:\w+\.)?(\w+)Client\s*$", body, re.M):
            if re.search(rf"\b{m[1]}\s*:\s*(?:\w+\.)?New{m[2]}Client\(", text):  # proven by the factory that fills it
                yield "grpc_client", line_at(text, begin + m.start()), line_at(text, begin + m.end()), {"owner": s[1], "member": m[1], "service": m[2]}
        fields = []
        for m in re.finditer(r"^\s*(\w+)\s+([\w*\[\].]+)(?:\s+`([^`]*)`)?\s*$", body, re.M):
            name = re.search(r"json:\"([^,\"]+)", m[3] or "")
            required = bool(re.search(r"validate:\"[^\"]*\brequired\b", m[3] or ""))
            fields.append({"name": name[1] if name else m[1], "type": m[2].lstrip("*"), "validations": ["required"] * required, "required": required})
        if fields:
            yield "shape", line_at(text, s.start()), line_at(text, s.end()), {"name": s[1], "shape": json.dumps(fields)}
    for m in re.finditer(r"^func\s+\(\s*\w+\s+\*?(\w+)\s*\)\s*([A-Z]\w*)\s*\(", text, re.M):
        if m[1] in bases:
            yield "grpc_handler", line_at(text, m.start()), line_at(text, m.end()), {"service": bases[m[1]], "method": m[2], "symbol": f"{m[1]}.{m[2]}"}


def _node(text: str) -> Iterator[Fact]:
    for family, made in (("mongoose", r"mongoose\.model\s*(?:<[^>]+>)?\s*\("), ("prisma", r"new\s+PrismaClient\s*(?:<[^>]+>)?\s*\(")):
        for m in re.finditer(rf"\b(?:const|let|var)\s+(\w+)\s*=\s*{made}", text):
            yield "variable", line_at(text, m.start()), line_at(text, m.end()), {"name": m[1], "family": family}
    for m in re.finditer(r"@GrpcMethod\(\s*['\"](\w+)['\"](?:\s*,\s*['\"](\w+)['\"])?\s*\)\s*(?:async\s+)?(\w+)\s*\(", text):
        yield "grpc_handler", line_at(text, m.start()), line_at(text, m.end()), {"service": m[1], "method": m[2] or m[3][:1].upper() + m[3][1:], "symbol": m[3]}


def declarations_in(path: str, text: str | None) -> list[Fact]:
    if not text:
        return []
    end = path.rsplit(".", 1)[-1].lower()
    rule = _jvm if end in ("java", "kt") else _go if end == "go" else _node if end in ("js", "jsx", "ts", "tsx", "mjs", "cjs") else None
    return list(rule(without_comments(text))) if rule else []


def declared(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """What every file declares, in the schema of facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, p, a, b, list(f.items())) for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, a, b, f in declarations_in(p, t)]
            kind, paths, start, end, fields = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(paths, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(fields, pa.map_(pa.string(), pa.string()))], ["kind", "path", "start_line", "end_line", "fields"])

    workers_find_us(files.sparkSession)
    return files.filter(f"{path} IS NOT NULL").select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, extract.SCHEMA)


# --- joins ----------------------------------------------------------------------------------------------------------


def operations(spark: SparkSession) -> DataFrame:
    """(family, method, operation): the table of operations, methods in lower case."""
    return spark.createDataFrame([(f, m, o) for f, kinds in OPERATIONS.items() for o, methods in kinds.items() for m in methods], "family string, method string, operation string")


def _fields(declarations: DataFrame, kind: str, *names: str) -> DataFrame:
    return declarations.filter(F.col("kind") == kind).select("path", *(F.col("fields")[n].alias(n) for n in names))


def _starts(method: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | method.startswith(w)
    return out


def classified(edges: DataFrame, declarations: DataFrame) -> DataFrame:
    """Edges (path, from_symbol, to_symbol, kind, ...) whose kind is told by the declared type of their receiver, where there is one."""
    spark = edges.sparkSession
    target = F.regexp_replace("to_symbol", r"^this\.", "")
    e = edges.withColumn("_receiver", F.regexp_extract(target, r"^(.*)\.\w+$", 1)).withColumn("_method", F.substring_index(target, ".", -1)).withColumn("_root", F.substring_index(target, ".", 1)).withColumn("_owner", F.regexp_extract("from_symbol", r"^(.*)\.\w+$", 1))
    members = _fields(declarations, "member", "owner", "name", "type").groupBy("path", "owner", "name").agg(F.min("type").alias("_type"), F.countDistinct("type").alias("_n")).filter("_n = 1").drop("_n")
    repositories = _fields(declarations, "repository", "name").select(F.col("name").alias("_type"), F.lit(True).alias("_derives")).distinct()
    queries = _fields(declarations, "query_method", "repository", "method", "operation").groupBy(F.col("repository").alias("_type"), F.col("method").alias("_method")).agg(F.max("operation").alias("_query"))
    parameters = _fields(declarations, "parameter", "symbol", "name", "family").select("path", F.col("symbol").alias("from_symbol"), F.col("name").alias("_root"), F.col("family").alias("_parameter")).distinct()
    variables = _fields(declarations, "variable", "name", "family").select("path", F.col("name").alias("_root"), F.col("family").alias("_variable")).distinct()
    e = e.join(members.select("path", F.col("owner").alias("_owner"), F.col("name").alias("_receiver"), "_type"), ["path", "_owner", "_receiver"], "left")
    e = e.join(repositories, "_type", "left").join(queries, ["_type", "_method"], "left").join(parameters, ["path", "from_symbol", "_root"], "left").join(variables, ["path", "_root"], "left")
    of_type = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))[F.col("_type")]
    is_repository = F.col("_type").endswith("Repository") | F.col("_type").isin(REPOSITORY_BASES)
    depth = F.size(F.split(target, r"\."))
    # A model is called directly, a client by one delegate.
    variable = F.when(F.col("_variable") == "prisma", F.when(depth == 3, "prisma")).otherwise(F.when(depth == 2, F.col("_variable")))
    direct = F.when((F.col("_parameter") == "sql") & (depth > 2), None).otherwise(F.col("_parameter"))
    family = F.coalesce(of_type, F.when(is_repository, "repository"), direct, variable)
    e = e.withColumn("family", family).withColumn("method", F.lower("_method")).join(F.broadcast(operations(spark)), ["family", "method"], "left")
    derived = F.when(F.col("_derives") & _starts(F.col("_method"), DERIVED_READS), "reads").when(F.col("_derives") & _starts(F.col("_method"), DERIVED_WRITES), "writes")
    jdbc = F.when((F.col("family") == "jdbc") & F.col("_method").startswith("query"), "reads")
    return e.withColumn("kind", F.coalesce("_query", "operation", jdbc, derived, "kind")).select(*edges.columns)


def remote_calls(edges: DataFrame, declarations: DataFrame) -> DataFrame:
    """(path, source, target_service, protocol, target_method, target_path): calls of methods that a declared HTTP client maps, by a member of its type."""
    e = edges.select("path", F.col("from_symbol").alias("source"), F.regexp_extract("from_symbol", r"^(.*)\.\w+$", 1).alias("owner"), F.regexp_extract("to_symbol", r"^(?:this\.)?(\w+)\.\w+$", 1).alias("name"), F.substring_index("to_symbol", ".", -1).alias("method"))
    members = _fields(declarations, "member", "owner", "name", "type").distinct()
    names = {"client": "type", "service": "target_service", "method": "method", "verb": "target_method", "path": "target_path"}
    mapped = declarations.filter("kind = 'remote_method'").select(*(F.col("fields")[n].alias(a) for n, a in names.items()))
    one = mapped.groupBy("type", "method").agg(F.min("target_service").alias("target_service"), F.min("target_method").alias("target_method"), F.min("target_path").alias("target_path"), F.countDistinct("target_service", "target_method", "target_path").alias("_n")).filter("_n = 1").drop("_n")
    return e.join(members, ["path", "owner", "name"]).join(one, ["type", "method"]).select("path", "source", "target_service", F.lit("http").alias("protocol"), "target_method", "target_path").distinct()


def grpc_entrypoints(declarations: DataFrame, rpcs: DataFrame) -> DataFrame:
    """(path, symbol, name): handlers of the only declared RPC of their service and method, whose names differ in the case of their first letter at most; rpcs: (service, method)."""
    key = lambda c: F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))
    one = rpcs.groupBy("service", key(F.col("method")).alias("_m")).agg(F.min("method").alias("method"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    h = _fields(declarations, "grpc_handler", "service", "method", "symbol").withColumn("_m", key(F.col("method"))).drop("method")
    return h.join(one, ["service", "_m"]).select("path", "symbol", F.concat_ws("/", "service", "method").alias("name")).distinct()


def grpc_calls(edges: DataFrame, declarations: DataFrame, rpcs: DataFrame) -> DataFrame:
    """(path, source, name): calls on a generated client of one declared RPC."""
    key = lambda c: F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))
    target = F.regexp_replace("to_symbol", r"^(?:this|\w)\.(?=\w+\.\w+$)", "")
    e = edges.select("path", F.col("from_symbol").alias("source"), F.regexp_extract("from_symbol", r"^(.*)\.\w+$", 1).alias("owner"), F.regexp_extract(target, r"^(\w+)\.\w+$", 1).alias("member"), key(F.substring_index(target, ".", -1)).alias("_m"))
    clients = _fields(declarations, "grpc_client", "owner", "member", "service").distinct()
    one = rpcs.groupBy("service", key(F.col("method")).alias("_m")).agg(F.min("method").alias("method"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return e.join(clients, ["path", "owner", "member"]).join(one, ["service", "_m"]).select("path", "source", F.concat_ws("/", "service", "method").alias("name")).distinct()


def with_shapes(contracts: DataFrame, declarations: DataFrame, name: str) -> DataFrame:
    """Contracts with the fields of the data type that a column names, as JSON, where exactly one type has this name."""
    shapes = _fields(declarations, "shape", "name", "shape").groupBy(F.col("name").alias("_name")).agg(F.min("shape").alias("shape"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return contracts.join(shapes, contracts[name] == shapes["_name"], "left").drop("_name")


def shape_fields(declarations: DataFrame, by: list[str]) -> DataFrame:
    """(by, owner, name, type, required): the fields of the data types that exactly one declaration of `by` has, lists and pointers taken off."""
    shapes = declarations.filter("kind = 'shape'").groupBy(*by, F.col("fields")["name"].alias("owner")).agg(F.min(F.col("fields")["shape"]).alias("shape"), F.count("*").alias("_n")).filter("_n = 1")
    one = shapes.select(*by, "owner", F.explode(F.from_json("shape", "array<struct<name:string,type:string,required:boolean>>")).alias("f"))
    bare = F.regexp_replace(F.regexp_extract("f.type", r"^(?:(?:List|Set|Collection|Optional|Iterable)<)?([\w*\[\].]+)>?$", 1), r"^[*\[\]]+|^.*\.", "")
    return one.select(*by, "owner", "f.name", F.when(bare != "", bare).otherwise(F.col("f.type")).alias("type"), F.col("f.required").alias("required"))


def with_nested_shapes(contracts: DataFrame, declarations: DataFrame, name: str, by: list[str] = (), most: int = nesting.DEPTH) -> DataFrame:
    """Contracts with `shape`: the fields of the data type that a column names, and of the types of these, as JSON.

    A field has its path, type and state as in `nesting.unfolded`. Only types that exactly one declaration has are unfolded.
    """
    by = list(by)
    rows = nesting.unfolded(shape_fields(declarations, by), by, most)
    one = rows.groupBy(*by, F.col("root").alias("_name")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("path", "type", "state")))).alias("shape"))
    return contracts.join(one.select(*(F.col(c).alias(f"_{c}") for c in by), "_name", "shape") if by else one, [contracts[c] == F.col(f"_{c}") for c in by] + [contracts[name] == F.col("_name")], "left").drop("_name", *(f"_{c}" for c in by))
