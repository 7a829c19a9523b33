"""Table schemas. Nothing in the package infers a schema."""

EVENT = (
    "seq BIGINT, ts TIMESTAMP_NTZ, epoch BIGINT, log_type STRING, src_ip STRING, dst_ip STRING, "
    "src_port INT, dst_port INT, proto STRING, method STRING, url STRING, status_code INT, "
    "user_agent STRING, username STRING, detail MAP<STRING,STRING>, raw STRING"
)
RULE = (
    "id INT, name STRING, category STRING, severity STRING, rule_type STRING, pattern STRING, "
    "match_field STRING, threshold INT, time_window INT, group_field STRING, enabled BOOLEAN, "
    "description STRING, is_builtin BOOLEAN, count_mode STRING, distinct_field STRING"
)
HIT = (
    "rule_id INT, rule_name STRING, category STRING, severity STRING, seq BIGINT, epoch BIGINT, "
    "src_ip STRING, dst_ip STRING, url STRING, raw STRING, matched_text STRING, count BIGINT, "
    "prior_fails BIGINT, window_s INT, group_value STRING"
)
STATUS_CHANGE = "rule_name STRING, src_ip STRING, epoch BIGINT, status STRING"
FINDING = (
    "finding_id BIGINT, task_id BIGINT, target_id BIGINT, vuln_type STRING, severity STRING, "
    "url STRING, param STRING, payload STRING, evidence STRING, description STRING, "
    "fix_suggestion STRING, detected_at TIMESTAMP_NTZ"
)
RESPONSE = (
    "page_id BIGINT, host STRING, url STRING, status_code INT, headers MAP<STRING,STRING>, "
    "body STRING"
)
RANGE = "cidr STRING, label STRING, province STRING, category STRING"
