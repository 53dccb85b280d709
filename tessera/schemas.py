"""Schemas of the tables, as DDL."""

DOCS = "id string, title string, body string, source string, last_updated string"
TICKETS = "id string, summary string, description string, assignee string, reporter string, status string, priority string, services_affected array<string>, created string, source string"
COMMITS = "sha string, message string, author string, repo string, files_changed array<string>, timestamp string, pr string, source string"
LOGS = "id string, level string, service string, message string, timestamp string, source string"
RECORDS = "ord long, id string, type string, title string, body string, owner string, services_mentioned array<string>, timestamp string, source string, priority string, status string"

ENTITY = "struct<id:string,type:string,name:string,confidence:double,source:string>"
RELATION = "struct<from_id:string,relation:string,to_id:string,confidence:double,source:string>"
#: What a language model's answer, and the extraction cache, hold as JSON.
ANSWER = "struct<entities:array<struct<id:string,type:string,name:string>>,relationships:array<struct<from_id:string,`from`:string,relation:string,to_id:string,`to`:string>>>"
EXTRACTION = f"struct<entities:array<{ENTITY}>,relationships:array<{RELATION}>>"

CACHE = "text_hash string, result_json string, tier_used string, created_at string"
MANIFEST = "record_id string, content_hash string, source string, tier_used string, indexed_at string"
NODES = "id string, type string, title string, body string, source string, timestamp string, owner string, priority string, status string, name string, confidence double, extraction_source string, ord long"
EDGES = "from_id string, to_id string, relation string, confidence double, extraction_source string"
CHUNKS = "chunk_id string, doc_id string, filename string, text string, chunk_index int, total_chunks int"
VECTORS = "id string, text string, type string, source string, owner string, timestamp string, services string, priority string, status string, embedding array<float>"
