"""Schemas of the fact tables."""

CALL = "struct<target:string,line:int>"
HTTP = "struct<method:string,path:string,path_params:array<string>,is_feign_client:boolean>"
KAFKA = "struct<op:string,topic:string,line:int>"
DB = "struct<op:string,table:string,line:int>"
REDIS = "struct<op:string,key_pattern:string,line:int>"

#: What a source file's parse yields: one row for each file.
PARSED = (
    "file_path string, language string, error string, "
    "classes array<struct<name:string,line_start:int,line_end:int,is_interface:boolean,implements:array<string>>>, "
    f"methods array<struct<fqn:string,name:string,line_start:int,line_end:int,calls:array<{CALL}>,http:{HTTP},"
    f"kafka:array<{KAFKA}>,db:array<{DB}>,redis:array<{REDIS}>>>, "
    "imports array<struct<module:string,items:array<string>>>"
)
METHODS = (
    "fqn string, name string, file_path string, line_start int, line_end int, "
    f"calls array<{CALL}>, http {HTTP}, kafka array<{KAFKA}>, db array<{DB}>, redis array<{REDIS}>"
)
CLASSES = "name string, file_path string, line_start int, line_end int, is_interface boolean, implements array<string>"
IMPORTS = "file_path string, module string, items array<string>"
CONFIG_ITEMS = "file_path string, kind string, http_method string, value string"
CALLS = "caller string, callee string, line int"
HTTP_FACTS = "fqn string, method string, path string, path_params array<string>, is_feign_client boolean"
KAFKA_FACTS = "fqn string, op string, topic string, line int"
DB_FACTS = "fqn string, op string, table string, line int"
REDIS_FACTS = "fqn string, op string, key_pattern string, line int"
IMPLEMENTS = "class string, iface string"
HUNK_LINES = "file_path string, hunk_idx int, pos int, line_type string, content string"
HUNKS = (
    "project string, file_path string, change_type string, hunk_idx int, "
    "old_start int, old_lines int, new_start int, new_lines int"
)
NODES = "id string, kind string, label string, properties map<string,string>"
EDGES = "src string, dst string, edge_type string, direction string"
ISSUES = "severity string, message string"
