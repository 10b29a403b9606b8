"""Fixed values of the telemetry formats.

Everything in this module is data that has to keep its exact spelling or order
for results to agree with existing files: names, ranges, texts and markers.
"""

# The knob catalog, one "name type [min, max] [default]" per line.
KNOB_CATALOG_TEXT = """\
autovacuum_analyze_scale_factor real [0.0, 100.0] [0.1]
autovacuum_analyze_threshold integer [0, 2147483647] [50]
autovacuum_max_workers integer [1, 200] [3]
autovacuum_naptime integer [1, 2147483] [60]
autovacuum_vacuum_cost_delay integer [-1, 100] [2]
autovacuum_vacuum_cost_limit integer [-1, 10000] [-1]
autovacuum_vacuum_scale_factor real [0.0, 100.0] [0.2]
autovacuum_vacuum_threshold integer [0, 2147483647] [50]
backend_flush_after integer [0, 256] [0]
bgwriter_delay integer [10, 10000] [200]
bgwriter_flush_after integer [0, 256] [64]
bgwriter_lru_maxpages integer [0, 1000] [2]
bgwriter_lru_multiplier integer [0, 10] [2]
checkpoint_completion_target real [0.0, 1.0] [0.9]
checkpoint_flush_after integer [0, 256] [32]
checkpoint_timeout integer [30, 3600] [300]
commit_delay integer [0, 100000] [0]
commit_siblings integer [0, 1000] [5]
cursor_tuple_fraction real [0.0, 1.0] [0.1]
deadlock_timeout integer [1, 2147483647] [1000]
default_statistics_target integer [1, 10000] [100]
effective_cache_size integer [1, 2147483647] [524288]
effective_io_concurrency integer [0, 1000] [1]
from_collapse_limit integer [1, 2147483647] [8]
geqo_effort integer [1, 10] [5]
geqo_generations integer [0, 2147483647] [0]
geqo_pool_size integer [0, 2147483647] [0]
geqo_seed real [0.0, 1.0] [0.0]
geqo_threshold integer [2, 2147483647] [12]
join_collapse_limit integer [1, 2147483647] [8]
maintenance_work_mem integer [1024, 2147483647] [65536]
max_connections integer [50, 3000] [100]
max_wal_senders integer [0, 50] [10]
shared_buffers integer [16, 4194304] [1024]
temp_buffers integer [100, 1073741823] [1024]
temp_file_limit integer [-1, 2147483647] [-1]
vacuum_cost_delay integer [0, 100] [0]
vacuum_cost_limit integer [1, 10000] [200]
vacuum_cost_page_dirty integer [0, 10000] [20]
vacuum_cost_page_hit integer [0, 10000] [1]
vacuum_cost_page_miss integer [0, 10000] [2]
wal_buffers integer [-1, 131072] [-1]
wal_writer_delay integer [1, 10000] [200]
work_mem integer [64, 2147483647] [4096]
"""

# The 14 database counters, in the order of the list form.
METRIC_NAMES = [
    "xact_commit", "xact_rollback", "blks_read", "blks_hit", "tup_returned",
    "tup_fetched", "tup_inserted", "conflicts", "tup_updated", "tup_deleted",
    "disk_read_count", "disk_write_count", "disk_read_bytes", "disk_write_bytes",
]

# The six workload features, in the order of the feature text.
FEATURE_NAMES = [
    "size of workload", "read ratio", "group by ratio", "order by ratio",
    "aggregation ratio", "average predicate num per SQL",
]

# Markers counted in upper-cased statements.
AGGREGATE_MARKERS = ["SUM(", "COUNT(", "AVG(", "MAX(", "MIN("]
PREDICATE_MARKERS = ["WHERE", " AND ", " OR "]

# Legacy knob name -> current name.
KNOB_RENAMES = {
    "autovacuum_delay": "autovacuum_vacuum_cost_delay",
    "autovacuum_limit": "autovacuum_vacuum_cost_limit",
    "autovacuum_page_dirty": "vacuum_cost_page_dirty",
    "autovacuum_page_hit": "vacuum_cost_page_hit",
    "autovacuum_page_miss": "vacuum_cost_page_miss",
    "autovacuum_max_wal_senders": "max_wal_senders",
}

# The nine-word scale (the last spelling is part of the format).
SCALE_WORDS = [
    "extremely low", "very low", "low", "slightly low", "middle",
    "slightly high", "high", "very high", "extremyly high",
]

# Record fields of a sample that are not knobs.
RESERVED_FIELDS = ["y", "workload", "tps", "inner_metrics", "config_id"]

# Benchmark families and their run folders.
BENCHMARK_FOLDERS = {
    "ycsb": "ycsb_data",
    "tpcc": "tpcc_data",
    "smallbank": "smallbank",
    "twitter": "twitter",
    "wikipedia": "wikipedia",
}

# Numbers of the run protocol.
CRASH_COST = 2147483647.0
NO_VALID_COST = -1.0
BLOCK_BYTES = 8192
REPLAY_LIMIT = 3000
MIN_SAMPLES = 10
N_BUCKETS = 10
N_FOLDS = 10
HOLDOUT_WORKLOADS = 7
RUN_LIMIT = 100
SEED = 42
TRAIN_SHARE = 0.9

# Texts of the instruction records and prompts.
BEST_INSTRUCTION = "Predict the best database configuration based on the internal metrics."
SYSTEM_TEXT = (
    "You are an expert database tuning assistant. Your task is to analyze internal "
    "database metrics and select the optimal configuration buckets (percentage ranges) "
    "for various knobs to maximize performance."
)
INSTRUCTION_TEXT = (
    "Based on the provided internal metrics, predict the best configuration knobs. You "
    "MUST output the result as a valid JSON object. The keys should be the database "
    "configuration knobs, and the values should be the recommended percentage ranges "
    "(e.g., '10-20%'). Do not provide any explanations or additional text."
)
PROMPT_HEAD = (
    "You are an expert in database, you are to optimize the parameters of database, "
    "please output in json format, for each field, output one of \"00% to 10%\", "
    "\"10% to 20%\", \"20% to 30%\", \"30% to 40%\", \"40% to 50%\", \"50% to 60%\", "
    "\"60% to 70%\", \"70% to 80%\", \"80% to 90%\", \"90% to 100%\". The follow "
    "information of workloads are offered for you: features, query plans and inner "
    "metrics. Every SQL in the workload corresponds to a query plan tree and the query "
    "plan tree is represented using parentheses, where each node is followed by a pair "
    "of parentheses containing its child nodes, with sub-nodes separated by parentheses, "
    "recursively showing the entire tree's hierarchical structure. Additionally, each "
    "node carries a cost value estimated by PostgreSQL."
)
PROMPT_FEATURES = "\n                workload features: "
PROMPT_PLANS = " query plans in workload: "
PROMPT_METRICS = "; inner metrics: "
CHAT_START = "<|im_start|>"
CHAT_END = "<|im_end|>"

# Column manifest of the written training records.
RECORD_COLUMNS = {
    "prompt": "instruction",
    "query": "input",
    "response": "output",
    "system": "system",
}
THROUGHPUT_KEY = "Throughput (requests/second)"
