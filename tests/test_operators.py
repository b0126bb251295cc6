import pytest
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions import text as T
from loomgraph.operators import chunking, classify, crossapp, linking, relational, reports, retrieval, traverse, upsert
from loomgraph.plans import graph_queries, question
from loomgraph.sources import readers


def one(spark, expression, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expression.alias("x")).first()[0]


# functions
def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, T.normalize_query(c), t="  what\n is   this ?!") == "what is this "
    assert one(spark, T.content_hash(c), t="hello world") == "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"
    assert one(spark, T.token_count(c), t="  hello   world  test  ") == 3
    assert [one(spark, T.cyrillic_ratio(c), t=x) for x in ("Привет", "Hello", "ТестTest")] == [1.0, 0.0, 0.5]
    assert one(spark, T.normalize_path(c), t="https://ups-service:8080/ups/v1/findEstoDto/") == "/ups/v1/findestodto"
    assert one(spark, T.normalize_path(c), t="${X}/a") is None
    assert one(spark, T.coverage(F.lit("a = 1"), F.lit("anything"))) == 10.0 and one(spark, T.coverage(F.lit(" "), F.lit("x"))) == 0.0
    assert one(spark, T.simple_name(c), t="com.acme.Box<String>") == "Box"
    assert one(spark, T.env_var(c), t="${UPS_URL:https://x}") == "UPS_URL" and one(spark, T.env_default(c), t="${UPS_URL:https://x}") == "https://x"
    assert one(spark, T.readable_infra_name(F.lit("rr.ups-client.settings"), F.lit("HTTP"))) == "ups-client (HTTP)"
    assert one(spark, T.first_score(c), t="I give 12 points") == 10.0
    assert T.backoff_seconds(3) == 4.0 and T.backoff_seconds(20) == 30.0


def test_two_stage_filter(spark):
    rows = spark.createDataFrame([(1, "class Step15Processor { }"), (2, "class Step16Processor { }"), (3, "class Step15ProcessorHelper { }")], "id long, content string")
    assert [r.id for r in retrieval.two_stage_filter(rows, ["Step15Processor"]).collect()] == [1]
    loose = spark.createDataFrame([(1, "UserServiceHelper class"), (2, "UserServiceManager class"), (3, "ProductService class")], "id long, content string")
    assert sorted(r.id for r in retrieval.two_stage_filter(loose, ["UserService"]).collect()) == [1, 2]


def test_cover_density(spark):
    df = spark.createDataFrame([(["a", "x", "b", "a"],), (["a", "x"],)], "t array<string>")
    assert [r[0] for r in df.select(retrieval.cover_density(F.col("t"), ["a", "b"])).collect()] == [pytest.approx(1 / 3 + 1 / 2), 0.0]


# traversal
EDGES = [(1, 2, "CALLS_CODE"), (2, 3, "CALLS_CODE"), (3, 1, "DEPENDS_ON"), (3, 4, "CONTAINS"), (5, 4, "LOCKS")]


def test_impact(spark):
    edges = spark.createDataFrame([(1, 2, "CALLS_CODE"), (2, 3, "CALLS_CODE")], schema.EDGE)
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {(r.id, r.depth) for r in traverse.impact(edges, nodes, 3).collect()} == {(2, 1), (1, 2)}
    with pytest.raises(ValueError):
        traverse.impact(edges, nodes, 99)


def dijkstra(edges, start, hops):
    best = {(start, 0): 0.0}
    for h in range(hops):
        for (node, k), cost in list(best.items()):
            if k == h:
                for a, b, kind in edges + [(b, a, kind) for a, b, kind in edges]:
                    if a == node:
                        new = cost + schema.PATH_COST.get(kind, schema.DEFAULT_COST)
                        if new < best.get((b, h + 1), 1e9):
                            best[b, h + 1] = new
    out = {}
    for (node, _), cost in best.items():
        out[node] = min(cost, out.get(node, 1e9))
    return out


def test_shortest_paths_against_brute_force(spark):
    edges = spark.createDataFrame(EDGES, schema.EDGE)
    pairs = spark.createDataFrame([(a, b) for a in range(1, 6) for b in range(1, 6)], "from_id long, to_id long")
    found = {(r.from_id, r.to_id): r.cost for r in traverse.shortest_paths(edges, pairs, 4).collect()}
    for a in range(1, 6):
        for b, cost in dijkstra(EDGES, a, 4).items():
            assert found[a, b] == pytest.approx(cost)
    assert found[1, 1] == 0.0


def test_expansion_and_empty_seeds(spark):
    edges = spark.createDataFrame([(100, 200, "CALLS_CODE"), (300, 100, "LOCKS")], schema.EDGE)
    seeds = spark.createDataFrame([(100,)], "id long")
    assert [(r.id, r.weight) for r in traverse.expand(edges, seeds, 2).collect()] == [(200, 1.0)]
    assert traverse.expand(edges, seeds.limit(0), 1).count() == 0


def test_closure_with_cycle(spark):
    own = spark.createDataFrame([(1, "a"), (2, "b")], "id long, value string")
    calls = spark.createDataFrame([(1, 2, "C"), (2, 1, "C"), (3, 1, "C")], schema.EDGE)
    assert {(r.id, r.value) for r in traverse.closure_sets(own, calls).collect()} == {(i, v) for i in (1, 2, 3) for v in "ab"}


def test_summaries_over_all_levels(spark):
    chain = [(i, i + 1, "C") for i in range(1, 21)] + [(21, 19, "C"), (3, 30, "C"), (30, 5, "C")]
    calls = spark.createDataFrame(chain, schema.EDGE)
    own = spark.createDataFrame([(i, [f"u{i}"], i == 21, False) for i in [*range(1, 22), 30]], "id long, urls array<string>, has_retry boolean, has_timeout boolean")
    found = {r.id: r for r in traverse.summaries(own, calls).collect()}
    assert len(found) == 22 and len(found[1].urls) == 22 and set(found[20].urls) == {"u19", "u20", "u21"}
    assert all(r.has_retry and not r.has_timeout for r in found.values())


def test_climb_to_far_stops(spark):
    calls = spark.createDataFrame([(i + 1, i, "C") for i in range(1, 21)] + [(30, 1, "C"), (31, 30, "C"), (40, 41, "C"), (41, 40, "C")], schema.EDGE)
    sites, stops = spark.createDataFrame([(1,), (30,), (40,)], "id long"), spark.createDataFrame([(20,), (21,), (30,), (31,)], "id long")
    assert sorted(map(tuple, traverse.climb(calls, sites, stops).collect())) == [(1, 20, 19), (1, 30, 1), (30, 30, 0)]


def test_kinds_below_a_package_at_any_depth(spark, tmp_path):
    rows = [(1, None, "PACKAGE")] + [(i, i - 1, "CLASS" if i < 15 else "METHOD") for i in range(2, 16)]
    spark.createDataFrame(rows, "id long, parent_id long, kind string").write.parquet(str(tmp_path / "node.parquet"))
    found = graph_queries.ancestors_closure(spark, str(tmp_path)).collect()
    assert sorted((r.package_id, r.kind, r.n, r.least_depth) for r in found) == [(1, "CLASS", 13, 1), (1, "METHOD", 1, 14)]


def test_reach_without_bound(spark):
    edges = [(i, i + 1, "C") for i in range(1, 21)] + [(21, 19, "C"), (3, 30, "C"), (30, 7, "C"), (40, 40, "C")]
    want = set()
    for root in (1, 20, 40):
        depth, front = {root: 0}, [root]
        while front:
            at = front.pop(0)
            for a, b, _ in edges:
                if a == at and b not in depth:
                    depth[b] = depth[at] + 1
                    front.append(b)
        want |= {(root, i, d) for i, d in depth.items() if d}
    roots = spark.createDataFrame([(1,), (20,), (40,)], "id long")
    df = spark.createDataFrame(edges, schema.EDGE)
    assert sorted(map(tuple, traverse.reach(df, roots, None).collect())) == sorted(want)
    assert traverse.reach(df, roots.limit(0), None).count() == 0


# linking
def link_nodes(spark, usages):
    rows = [
        (1, "com.example.Owner", "Owner", "CLASS", None, None, None),
        (2, "com.example.Owner.process(String)", "process", "METHOD", None, None, "com.example.Owner"),
        (3, "com.example.Owner.process(Int)", "process", "METHOD", None, None, "com.example.Owner"),
        (4, "com.example.Service", "Service", "CLASS", None, None, None),
        (5, "com.example.Service.handle(Int)", "handle", "METHOD", None, None, "com.example.Service"),
        (6, "com.other.Owner.run()", "run", "METHOD", ["com.example.Service"], usages, "com.example.Owner"),
    ]
    df = spark.createDataFrame(rows, f"id long, fqn string, name string, kind string, imports array<string>, usages {schema.RAW_USAGES}, owner_fqn string")
    return df.withColumn("application_id", F.lit(1)).withColumn("package", F.lit("com.other"))


@pytest.mark.parametrize(
    ("usages", "expected"),
    [
        ([("simple", None, None, "process", True)], {2, 3}),
        ([("dot", "Service", "handle", None, True)], {5}),
        ([("simple", None, None, "Service", True)], {4}),
        ([("simple", None, None, "Service", False)], set()),
        ([("dot", "other", "process", None, True)], {2, 3}),
    ],
)
def test_calls(spark, usages, expected):
    assert {r.dst_id for r in linking.calls(link_nodes(spark, usages)).collect()} == expected


def test_inheritance_throws_and_config(spark):
    rows = [(1, "a.Face", "INTERFACE", "a", None, None, None, None), (2, "a.Base", "CLASS", "a", None, None, None, None), (3, "b.Impl", "CLASS", "b", ["a.Face", "a.Base"], ["Face", "Base"], ["@Base(1)"], ["Base"])]
    nodes = spark.createDataFrame(rows, "id long, fqn string, kind string, package string, imports array<string>, supertypes array<string>, annotations array<string>, throws_types array<string>").withColumn("application_id", F.lit(1)).withColumn("supertypes_resolved", F.lit(None).cast("array<string>"))
    assert {(r.dst_id, r.kind) for r in linking.inheritance(nodes).collect()} == {(1, "IMPLEMENTS"), (1, "DEPENDS_ON"), (2, "INHERITS"), (2, "DEPENDS_ON")}
    assert {(r.src_id, r.dst_id) for r in linking.throws(nodes).collect()} == {(3, 2)}
    assert {(r.dst_id, r.kind) for r in linking.annotations(nodes).collect()} == {(2, "ANNOTATED_WITH"), (2, "DEPENDS_ON")}
    members = spark.createDataFrame([(7, "FIELD", '@Value("${rr.ups.api-url}") val x'), (8, "CONFIG", '@ConfigurationProperties("rr.ups")')], "id long, kind string, source_code string")
    groups = spark.createDataFrame([("rr",), ("rr.ups",)], "grp string")
    assert {(r.src_id, r.grp, r.kind) for r in linking.config_edges(members, groups).collect()} == {(7, "rr.ups", "DEPENDS_ON"), (8, "rr.ups", "CONFIGURES")}


def test_integration_points(spark):
    df = spark.createDataFrame([(1, ((["/api"], ["GET"], ["t1"], [("t1", "PRODUCE", "x")], ["kafka:t2"], [("kafka:t2", "FROM")], False, True, False, False))), (2, ((["/b"], [], [], [], [], [], False, False, False, False)))], f"method_id long, analysis {schema.INTEGRATION}")
    points = linking.integration_points(df)
    assert {(r.method_id, r.type, r.target, r.verb, r.operation) for r in points.collect()} == {(1, "HTTP", "/api", "GET", None), (1, "KAFKA", "t1", None, "PRODUCE"), (1, "CAMEL", "kafka:t2", None, "FROM"), (2, "HTTP", "/b", None, None)}
    callers = spark.createDataFrame([(10, 1)], "src_id long, method_id long")
    edges = linking.integration_edges(callers, points, df.select("method_id", "analysis.hasRetry", "analysis.hasTimeout", "analysis.hasCircuitBreaker"))
    assert {(r.target_fqn, r.kind) for r in edges.collect()} == {("infra:http:GET:/api", "CALLS_HTTP"), ("infra:http:GET:/api", "RETRIES_TO"), ("infra:kafka:topic:t1", "PRODUCES"), ("infra:camel:uri:kafka:t2", "CALLS_CAMEL")}
    assert linking.virtual_nodes(edges, spark.createDataFrame([("infra:kafka:topic:t1",)], "fqn string")).count() == 2


def test_cross_application(spark):
    server = spark.createDataFrame([(1, "GET", "/ups/v1", "/findEstoDto")], "application_id long, verb string, base_path string, path string")
    client = spark.createDataFrame([(2, "GET", "https://ups-service:8080/ups/v1/findEstoDto"), (1, "GET", "/ups/v1/findEstoDto")], "application_id long, verb string, url string")
    matches = crossapp.endpoint_matches(server, client)
    assert [tuple(r) for r in matches.collect()] == [("GET /ups/v1/findestodto", 1, 2)]
    fqn = "infra:http:GET:https://api.example.com/users"
    nodes = spark.createDataFrame([(1, 1, fqn, None, True), (2, 2, fqn, None, True), (3, 1, "a.m", "m", False), (4, 2, "b.m", "m", False)], "id long, application_id long, fqn string, name string, synthetic boolean")
    edges = spark.createDataFrame([(3, 1, "CALLS_HTTP"), (4, 2, "CALLS_HTTP")], schema.EDGE)
    stats = crossapp.statistics(crossapp.graph(crossapp.contracts(nodes.selectExpr("id", "application_id", "fqn", "'X' AS kind", "CAST(NULL AS array<string>) AS supertypes"), nodes.selectExpr("id AS parent_id", "'METHOD' AS kind")), crossapp.integrations(nodes, edges), matches.limit(0))).first()
    assert (stats.http, stats.kafka, stats.edges) == (1, 0, 2)


# classification
def test_stacktrace(spark):
    trace = "java.lang.RuntimeException: x\nCaused by: a.BException: y\n at java.util.List.get(List.java:1)\nCaused by: java.lang.IllegalArgumentException: z\n at org.springframework.X.y(X.java:3)\n at com.acme.UserService.getUser(UserService.kt:42)"
    df = spark.createDataFrame([(1, trace)], "k int, t string")
    root = classify.root_cause(df, "k", "t").first()
    assert (root.cause, root.owner, root.method, root.line) == ("java.lang.IllegalArgumentException", "com.acme.UserService", "getUser", 42)
    assert one(spark, classify.intent(F.col("t")), t=trace) == "STACKTRACE"
    assert one(spark, classify.intent(F.col("t")), t="где класс OrderService?") == "EXACT"
    assert one(spark, classify.named_class(F.col("t")), t="что делает класс OrderService") == "OrderService"


@pytest.mark.parametrize(("name", "package", "imports", "expected"), [("OrderConsumer", "a", ["org.apache.kafka.X"], "TOPIC"), ("OrderConsumer", "a.messaging", [], "TOPIC"), ("OrderTest", "a", [], "TEST"), ("AppConfig", "a", [], "CONFIG"), ("Foo", "a", [], "CLASS"), ("OrderDao", "a", [], "DB_QUERY")])
def test_kind_rules(spark, name, package, imports, expected):
    none = F.lit(None).cast("array<string>")
    arr = F.array(*[F.lit(i) for i in imports]).cast("array<string>")
    assert one(spark, classify.refine_type(F.lit("CLASS"), F.lit(name), F.lit(package), none, none, arr)) == expected


# writes
def test_upserts(spark):
    edges = spark.createDataFrame([(1, 2, "C")], schema.EDGE)
    assert upsert.insert_missing(edges, edges.union(edges), ["src_id", "dst_id", "kind"]).count() == 1
    old = spark.createDataFrame([("a", 1, "s"), ("b", 2, "s")], "k string, v long, status string")
    new = spark.createDataFrame([("b", 9, "t"), ("c", 3, "t")], "k string, v long, status string")
    assert {tuple(r) for r in upsert.replace_rows(old, new, ["k"], ("status",)).collect()} == {("a", 1, "s"), ("b", 9, "s"), ("c", 3, "t")}
    assert one(spark, upsert.merge_value("PREFER_LONGER", F.lit("ab"), F.lit("abc"))) == "abc" and one(spark, upsert.merge_value("GRADE_BETTER", F.lit("B"), F.lit("C"))) == "B"
    meta = spark.sql("SELECT map('a', '1', 'b', '2', 'c', '3') AS o, map('a', CAST(NULL AS STRING), 'b', '', 'c', '9') AS n")
    assert meta.select(upsert.merge_meta(F.col("o"), F.col("n"))).first()[0] == {"b": "2", "c": "9"}


def test_judges_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 8.0), ("a", 9.0), ("b", 7.0), ("b", None)], "k string, s double")
    got = {r.k: (r.mean, r.variance, r.confidence) for r in relational.judge_summary(df, "k", "s").collect()}
    assert got == {"a": (8.5, 0.5, 0.666667), "b": (7.0, 0.0, 1.0)}
    assert relational.global_counts(a=df, b=df.limit(0)).first().asDict() == {"a": 4, "b": 0}


# sources, chunks and reports
def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "build").mkdir()
    (tmp_path / "src/A.kt").write_text('package com.acme\nimport a.B\n/** Says hello. */\n@Service\nclass Greeter(val x: Int) : Base(), Face {\n    private val name: String = "x { "\n    fun hello(who: String, n: Int): String {\n        return who\n    }\n    class Inner { fun deep() = 1 }\n}\n')
    (tmp_path / "build/B.kt").write_text("class Gone")
    found = readers.scan_sources(readers.read_files(spark, str(tmp_path), "*.kt"))
    rows = {r.fqn: r for r in readers.plan_nodes(found, 1).collect()}
    assert {"com.acme.Greeter", "com.acme.Greeter.hello(String,Int)", "com.acme.Greeter.name", "com.acme.Greeter.Inner"} <= set(rows) and not any("Gone" in f for f in rows)
    assert rows["com.acme.Greeter"].supertypes == ["Base", "Face"] or set(rows["com.acme.Greeter"].supertypes) >= {"Face"}


def test_yaml_and_proto(spark):
    text = "spring:\n  kafka:\n    servers: [a]\n  list:\n    - one\n    - name: two # note\n      value: 3\nflat.key: 'x # y'\n"
    assert dict(readers.flatten_yaml(text)) == {"spring.kafka.servers[0]": "a", "spring.list[0]": "one", "spring.list[1].name": "two", "spring.list[1].value": "3", "flat.key": "x # y"}
    files = spark.createDataFrame([("a.proto", "message M { string a = 1; }\nservice S { rpc Get (M) returns (M); rpc Put (M) returns (M) {} }")], "path string, text string")
    assert {(r.kind, r.name) for r in readers.scan_proto(files).collect()} == {("MESSAGE", "M"), ("SERVICE", "S"), ("RPC", "Get"), ("RPC", "Put")}


def test_models_are_injected(spark):
    nodes = spark.createDataFrame([(1, "a.b", "b", "()", "code"), (2, "a.c", "c", None, None)], "id long, fqn string, name string, signature string, source_code string")
    docs = {r.node_id: r.doc_digest for r in chunking.generate_docs(nodes, "en", lambda prompts: ["" if "a.c" in p else "Does b." for p in prompts]).collect()}
    assert docs == {1: "Does b.", 2: "no-content"}
    results = spark.createDataFrame([(1, "a", 0.1), (2, "bb", 0.2)], "id long, content string, similarity double")
    assert {r.similarity for r in retrieval.rerank(results, lambda texts: [len(t) for t in texts]).collect()} == {1.0, 2.0}
    assert {r.similarity for r in retrieval.rerank(results, lambda texts: 1 / 0).collect()} == {0.1, 0.2}


def test_profile(spark):
    rows = [(i, 1, f"p.e{i:02d}", None, "ENDPOINT", '{"httpMethod": "GET", "path": "/x"}' if i == 1 else None) for i in range(1, 54)]
    rows += [(100, 1, "p.orders", "orders", "DB_TABLE", None), (101, 1, "p.C", "C", "CLASS", None), (102, 1, "p.Async", "MyAsyncThing", "ANNOTATION", None)]
    nodes = spark.createDataFrame(rows, "id long, application_id long, fqn string, name string, kind string, meta string")
    edges = spark.createDataFrame([(i, 100, "READS") for i in range(1, 9)] + [(101, 100, "WRITES"), (101, 102, "ANNOTATED_WITH")], schema.EDGE)
    told = {(r.section, r.position): r.line for r in reports.profile(nodes, edges).collect()}
    assert told["endpoints", 1] == "- GET /x" and told["endpoints", 2] == "- p.e02" and told["endpoints", 51] == "- ... и ещё 3 эндпоинтов"
    assert told["data", 1] == "- DB_TABLE: orders (читают: p.e01, p.e02, p.e03, p.e04, p.e05; пишут: C)" and told["annotations", 1] == "- @MyAsyncThing: 1 использований"


def test_rules_of_scores_plans_and_questions(spark):
    c = F.col("t")
    assert one(spark, T.readability(c), t=" ") == 5.0
    assert one(spark, T.final_score(F.lit(10.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == 1.5 and one(spark, T.final_score(F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(0.0))) == 1.0 and one(spark, T.final_score(F.lit(3.0), F.lit(3.0), F.lit(3.0), F.lit(None).cast("double"))) == 3.0
    assert one(spark, T.type_tokens(c), t="fun Wrong<T>(a: Map<Key, val>): Res?") == ["Key", "Map", "Res"]
    assert one(spark, T.simple_calls(c), t="a.load(map(x), If(1))") == ["If", "load"] and one(spark, T.dotted_calls(c), t="x.timer.go(1); a.b.go(2)") == ["a.b.go"]
    assert one(spark, T.section(c, "Purpose"), t="## Purpose\n## Next\nx") is None and one(spark, T.section(c, "Purpose"), t="## Purpose of it\nline\n### sub\n## b") == "line\n### sub"
    for text, want in {"какие слои есть": "ARCHITECTURE", "слои": "DEFAULT", "OrderService": "EXACT", "getUser": "DEFAULT", "класс order": "EXACT", "at a.B.c(B.kt:1)\nCaused by: x": "STACKTRACE", "at a.B.c(B.kt)\nat a.B.d(B.kt)": "DEFAULT"}.items():
        assert one(spark, classify.intent(c), t=text) == want, text
    kinds = {k: one(spark, chunking.prompt_name(F.lit(k), F.lit(1), F.lit(0), F.lit(True))) for k in ("METHOD", "ENUM", "REPO", "INFRASTRUCTURE", "FIELD")}
    assert kinds == {"METHOD": "method-with-deps", "ENUM": "type-no-children", "REPO": "container-no-children", "INFRASTRUCTURE": "infrastructure", "FIELD": "leaf-with-code"}


def test_long_texts_are_embedded_whole(spark):
    rows = spark.createDataFrame([(1, "a" * 25 + "b" * 5, None, None, None)], "id long, content string, content_hash string, token_count int, embedding array<double>")
    share = lambda texts: [[t.count("b") / len(t)] for t in texts]
    assert chunking.post_process(rows, share, most=10).first().embedding == [pytest.approx(0.5 / 3)]
    assert chunking.post_process(rows, share, most=10, summarise=lambda ts: ["b"] * len(ts)).first().embedding == [1.0]


def test_yaml_blocks_and_flow():
    text = "a: |\n  one: two\n\n  three\nb: >-\n  x\n  y\nc: [1, \"t, u\", {k: v}]\nd: {e: f, g: [h]}\n"
    assert readers.flatten_yaml(text) == [("a", "one: two\n\nthree"), ("b", "x y"), ("c[0]", "1"), ("c[1]", "t, u"), ("c[2].k", "v"), ("d.e", "f"), ("d.g[0]", "h")]


def test_question_machine(spark):
    nodes = spark.createDataFrame([(1, 1, "a.OrderService", "OrderService", "CLASS", None)], "id long, application_id long, fqn string, name string, kind string, parent_id long")
    edges = spark.createDataFrame([(1, 2, "CALLS_CODE")], schema.EDGE)
    chunks = spark.createDataFrame([(10, 1, 1, "class orderservice text", [1.0, 0.0])], "id long, application_id long, node_id long, content string, embedding array<float>")
    synonyms = spark.createDataFrame([], "id long, term string, description string, term_embedding array<float>, desc_embedding array<float>")
    got = question.ask(question.Question("class OrderService ?"), question.Tables(spark, nodes, edges, chunks, synonyms))
    assert got.trail == ["NORMALIZATION", "INTENT", "EXACT", "GRAPH", "SEARCH", "DONE"] and [r.id for r in got.results.collect()] == [10]
    answer, ids = question.research("x", lambda log: "FINAL: done [id=3]" if "OBSERVATION" in log else "ACTION: find[y]", {"find": lambda s: "[id=7]"})
    assert answer == "done [id=3]" and ids == [3, 7]
