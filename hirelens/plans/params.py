"""Fixed parameters of the registered queries (shared by Spark code and oracle SQL)."""

from ..operators.aging import AgingThresholds

AS_OF = "2001-08-01"  # every fixture row is older than this date
THRESHOLDS = AgingThresholds(healthy_max=365, watch_max=1000, aging_max=1800)
FILTERS = {"recruiter": ["1-URGENT", "2-HIGH"], "client": ["BUILDING", "MACHINERY"]}
SEARCH_TEXT = "nation_1"
QUERY_SEARCH = "role 11"
QUERY_COLUMNS = ["candidate_id", "candidate_name", "recruiter", "client", "location", "nope"]
QUERY_LIMIT = 250
REGEX = r"tech [37]|^role 1[01]$"
LIST_SEARCH = "Role 1"
LIST_RECRUITER = "1-URGENT"
LOOKUP_ID = "CAND0000001"
STAGE_DIMS = {"client": ["BUILDING", "HOUSEHOLD"]}
STAGE_LIST = ["Joined", "Offer Declined", "Interview — No Show"]
TARGET_HIRES = 500
STUCK_DAYS = (14, 1500, 2000, 2400)
AUDIT_ID = "CAND0000013"
SNAPSHOT_BEFORE = "1998-01-01"  # earlier snapshot = applications before this date
TIMELINE_IDS = ["CAND0000247", "CAND0000029", "CAND0000199", "CAND0000323"]
