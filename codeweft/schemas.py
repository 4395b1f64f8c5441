"""Schemas of the graph's tables, as DDL, and the values its columns may hold."""

from __future__ import annotations

ANNOTATION = "struct<name:string,attributes:array<struct<name:string,value:string>>>"
METHOD = (
    "struct<name:string,signature:string,return_type:string,modifiers:array<string>,annotations:array<string>,"
    "type_parameters:array<string>,parameters:array<struct<type:string,name:string,annotations:array<string>>>,"
    "thrown_exceptions:array<string>,constructor:boolean,raw_body:string,internal_method_calls:array<string>,method_references:array<string>>"
)
TYPES = (
    "fqn string, package_name string, simple_name string, file_path string, language string, kind string, modifiers array<string>, "
    "annotations array<string>, import_nodes array<struct<name:string,is_static:boolean,is_wildcard:boolean>>, imports array<string>, "
    f"type_parameters array<string>, super_class string, interfaces array<string>, methods array<{METHOD}>, "
    "fields array<struct<type:string,name:string,annotations:array<string>,value:string>>, enum_constants array<struct<name:string,arguments:array<string>,annotations:array<string>>>, "
    "record_components array<struct<type:string,name:string,annotations:array<string>>>, static_initializers array<string>, language_metadata map<string,string>, status string"
)
NODES = "id string, kind string, fqn string, simple_name string, external boolean, community_id long, status string, updated_at long"
EDGES = "type string, from_id string, to_id string, weight double, provenance string, confidence_score double"
EMBEDDINGS = "node_id string, class_fqn string, kind string, vector array<float>"
HYPEREDGES = "id string, label string, relation string, node_ids array<string>, provenance string, confidence_score double"
QA = "id long, question string, answer string, node_fqns array<string>, created_at long"
MANIFEST = "path string, sha256 string"
RULES = "id string, name string, category string, match struct<annotations:array<string>,importPrefixes:array<string>,superClasses:array<string>,interfaces:array<string>>"
EVENTS = "kind string, node_id string, new_node_ids array<string>, old_signature string, new_signature string, new_file_path string, timestamp timestamp"

CLASS_KINDS = ("CLASS", "INTERFACE", "ENUM", "RECORD", "ANNOTATION")
STATUSES = ("PENDING", "IN_PROGRESS", "MIGRATED", "MANUAL_INTERVENTION", "EXTERNAL")
EDGE_TYPES = ("CONTAINS", "CALLS", "EXTENDS", "IMPLEMENTS", "DEPENDS_ON", "USES", "SEMANTICALLY_SIMILAR")
#: Order in which neighbours by these edges are visited.
TRAVERSAL_TYPES = ("DEPENDS_ON", "CALLS", "EXTENDS", "IMPLEMENTS", "USES", "SEMANTICALLY_SIMILAR")
PATH_TYPES = ("DEPENDS_ON", "EXTENDS", "IMPLEMENTS", "USES")
EDGE_WEIGHTS = {"CONTAINS": 1.0, "CALLS": 2.0, "EXTENDS": 1.0, "IMPLEMENTS": 1.0, "DEPENDS_ON": 3.0, "USES": 1.0}
COMMUNITY_WEIGHTS = {"DEPENDS_ON": 3.0, "CALLS": 2.0, "EXTENDS": 1.0, "IMPLEMENTS": 1.0}
EXTENSIONS = {"java": "JAVA", "kt": "KOTLIN", "py": "PYTHON", "go": "GO", "cs": "CSHARP", "rs": "RUST"}
