"""Column types of the tables the operators read and write."""

TRACE_EVENTS = (
    "id bigint, schema_version int, thread_id string, event_type string, node string, model string, started_at timestamp, "
    "duration_ms double, input_tokens bigint, output_tokens bigint, total_tokens bigint, estimated_tokens boolean, cost_usd double, "
    "payload string"
)
PRICING = "model string, input_per_million double, output_per_million double"
MANIFESTS = (
    "thread_id string, schema_version int, user_task string, status string, session string, current_url string, item_count int, "
    "completed_pages array<int>, next_nodes array<string>, last_verified_action_key string, created_at timestamp, updated_at timestamp"
)
SNAPSHOT_NODE = (
    "ref string, ref_type string, tag string, role string, name string, text string, placeholder string, label string, "
    "input_type string, value string, href string, parent_ref string, xpath string, interactable_now boolean, in_viewport boolean"
)
REGION = (
    "ref string, kind string, tag string, role string, name string, why string, item_count int, score int, "
    "sample_items array<struct<text:string,url:string>>"
)
SNAPSHOT = (
    "ok boolean, data struct<page:struct<url:string,title:string,page_id:string>,"
    "page_identity:struct<domain:string,snapshot_id:string,snapshot_seq:int,page_id:string>,"
    f"index:struct<interactable_elements:array<struct<{', '.join(f.replace(' ', ':', 1) for f in SNAPSHOT_NODE.split(', '))}>>,"
    f"surface_index:array<struct<{', '.join(f.replace(' ', ':', 1) for f in SNAPSHOT_NODE.split(', '))}>>,"
    f"deep_index:array<struct<{', '.join(f.replace(' ', ':', 1) for f in SNAPSHOT_NODE.split(', '))}>>,"
    "data_regions:array<struct<ref:string,kind:string,tag:string,role:string,name:string,why:string,item_count:int,score:int>>,"
    "stats:struct<total_nodes:int,interactable_now:int,in_viewport:int,offscreen:int>>>"
)
RUN = (
    "case struct<key:string,name:string,url:string,task:string,capability:string,expected_min_items:int,expected_max_items:int>, "
    "model string, repeat int, status string, exception string, elapsed_seconds double, thread_ids array<string>, "
    "usage struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint,llm_call_count:bigint,browser_action_count:bigint,"
    "cost_usd:double,llm_duration_ms:double,estimated_call_count:bigint>, "
    "evaluation struct<checks:map<string,boolean>,accuracy_score:double,unique_item_count:bigint,detail_batch_ran:boolean>, "
    "results array<struct<ok:boolean,action:string,error:struct<code:string,message:string>,page_url:string,items:array<map<string,string>>>>, "
    "session_close struct<ok:boolean>"
)
REQUESTS = "domain string, t bigint, seq bigint, kind string, interval_us bigint, cooldown_us bigint"
PROGRESS_EVENTS = "thread_id string, seq bigint, page_number int, identity string, item_json string, kind string, round int"
CACHE_FAILURES = "cache_id string, cache_type string, timestamp timestamp, reason string"
