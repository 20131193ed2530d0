"""Column sets of the tables that pass between jobs."""

QUEUE = ("id string, company string, posting_id string, role string, location string, link string, posted date, "
         "posted_source string, posted_reverified boolean, description_status string, site string, first_seen date, "
         "sponsorship_status string, sponsorship_evidence string, experience int, experience_evidence string, "
         "salary string, salary_evidence string, kw_hits array<string>, state string, first_run boolean, "
         "last_seen_live date, miss_count int, closed_on date, closed_reason string, repost_count int, repost_of string, "
         "reposted_on date, lineage_root string, lineage_first_seen date, ghost_status string, ghost_evidence string, "
         "ord bigint, alert_pending boolean, alert_attempts int, enrich_attempts int, enrich_next date, "
         "posted_before_refresh date, posted_est boolean, origin string")

SEEN = "company string, posting_id string"
SEEDED = "company string"
TOMBSTONES = "id string, reason string, on date"
FILTERED = ("company string, posting_id string, title string, location string, url string, rule_kind string, "
            "rule_term string, ord bigint")
FRESHNESS = "company string, n bigint, sig string, checked date, changed date"
SUMMARIES = "line string, attempts int"
SIGNATURE = "sig string"
