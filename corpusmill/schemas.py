"""Table schemas the operators read and write."""

from __future__ import annotations

FILES = "repo_url string, path string, content binary, size bigint"
REFS = "repo_url string, refname string, committer_ts timestamp, tip_sha string"
COMMITS = "repo_url string, sha string, parents array<string>, pos bigint, on_head boolean"
REQUESTS = "repo_url string, seq bigint, path string, layer string, start_line int, end_line int"

SAVED_FILE = (
    "struct<rank:bigint,path:string,layer:string,loc_taken:bigint,"
    "is_partial:boolean,language:string>"
)
MANIFEST_META = (
    "struct<model:string,agent_iterations:bigint,bash_calls:bigint,sampled_at:string,"
    "commit_sha:string,repo_lang_distribution:map<string,double>,"
    "lang_stats_source:string,primary_forced:boolean>"
)
MANIFEST = (
    "repo_url string, repo_name string, folder_name string, language string, "
    "total_loc bigint, file_count bigint, test_share double, "
    "sample_lang_distribution map<string,double>, "
    f"files array<{SAVED_FILE}>, repo_summary string, meta {MANIFEST_META}"
)
IDENTITY = (
    "first_commit_hash string, early_commit_hashes string, commit_minhash string, "
    "repo_url string, repo_org string, repo_name string, head_commit_sha string"
)
ERRORS = "repo_url string, stage string, error string, ts timestamp"
MESSAGES = (
    "run_id bigint, pos bigint, role string, content string, tool_call_id string, "
    "tool_calls array<struct<id:string,name:string,arguments:string>>"
)

# Layer names and their groups.
LAYERS = (
    "business", "algorithm", "data", "api", "util", "test", "infra", "boilerplate", "autogen",
)
LOGIC_LAYERS = ("business", "algorithm", "data", "api")
LOW_VALUE_LAYERS = ("boilerplate", "infra", "autogen")

# Column order of the delivery index.
INDEX_COLUMNS = (
    "folder", "repo_name", "repo_org", "repo_url", "first_commit_hash", "early_commit_hashes",
    "commit_minhash", "sample_loc", "sample_files", "sampled_at", "head_commit_sha",
    "sampler_version",
)
