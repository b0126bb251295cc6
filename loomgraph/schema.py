"""Kinds and tables of the data model."""

# fixed values: kinds of nodes and edges
NODE_KINDS = (
    "REPO", "MODULE", "PACKAGE", "CLASS", "INTERFACE", "ENUM", "RECORD", "FIELD", "METHOD", "EXCEPTION", "TEST", "MAPPER", "SERVICE", "ENDPOINT", "CLIENT",
    "TOPIC", "JOB", "DB_TABLE", "DB_VIEW", "DB_QUERY", "SCHEMA", "CONFIG", "MIGRATION", "ANNOTATION", "INFRASTRUCTURE",
)
EDGE_KINDS = (
    "CONTAINS", "DEPENDS_ON", "IMPLEMENTS", "EXTENDS", "INHERITS", "OVERRIDES", "ANNOTATED_WITH", "CALLS", "CALLS_CODE", "CALLS_HTTP", "CALLS_GRPC", "CALLS_CAMEL",
    "PRODUCES", "CONSUMES", "QUERIES", "READS", "WRITES", "CONTRACTS_WITH", "CONFIGURES", "THROWS", "LOCKS", "RETRIES_TO", "TIMEOUTS_TO", "CIRCUIT_BREAKER_TO",
)
TYPE_KINDS = ("CLASS", "INTERFACE", "ENUM", "RECORD", "SERVICE", "MAPPER", "EXCEPTION", "CLIENT", "CONFIG", "ENDPOINT")

# fixed values: cost of a step on a weighted path, and weight of an edge in an expansion
PATH_COST = {"CALLS_CODE": 1.0, "IMPLEMENTS": 1.2, "DEPENDS_ON": 1.5, "CALLS_HTTP": 1.5, "PRODUCES": 2.0, "CONSUMES": 2.0, "READS": 2.0, "WRITES": 2.0, "CONTAINS": 2.5}
DEFAULT_COST = 3.0
EDGE_WEIGHT = {"CALLS_CODE": 1.0, "IMPLEMENTS": 0.8, "DEPENDS_ON": 0.7, "CALLS_HTTP": 0.7, "PRODUCES": 0.6, "CONSUMES": 0.6, "READS": 0.5, "WRITES": 0.5, "CONTAINS": 0.5}

EDGE = "src_id BIGINT, dst_id BIGINT, kind STRING"
RAW_USAGES = "array<struct<type:string,receiver:string,member:string,name:string,isCall:boolean>>"
META = (
    "struct<source:string,pkgFqn:string,ownerFqn:string,imports:array<string>,annotations:array<string>,supertypesSimple:array<string>,supertypesResolved:array<string>,"
    "signature:string,paramTypes:array<string>,returnType:string,modifiers:array<string>,kdoc:string,throwsTypes:array<string>,synthetic:boolean,rawUsages:" + RAW_USAGES + ">"
)
INTEGRATION = (
    "struct<urls:array<string>,httpMethods:array<string>,kafkaTopics:array<string>,kafkaCalls:array<struct<topic:string,operation:string,clientType:string>>,"
    "camelUris:array<string>,camelCalls:array<struct<uri:string,direction:string>>,isParentClient:boolean,hasRetry:boolean,hasTimeout:boolean,hasCircuitBreaker:boolean>"
)
