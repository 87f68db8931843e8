"""Vocabulary of the funnel: stage names, stage order, channels.

These are fixed values: results only agree with the reference when they are
exactly these strings and numbers, so they are kept here, together, in their
natural order.
"""

# --- fixed values -----------------------------------------------------------

# event_name -> stage_order (verification_rejected shares tier 5 with approved)
STAGE_ORDER = [
    ("signup", 1),
    ("profile_started", 2),
    ("profile_completed", 3),
    ("verification_submitted", 4),
    ("verification_approved", 5),
    ("verification_rejected", 5),
    ("first_engagement_completed", 6),
]

# event_name -> column of the per-expert pivot holding its first time
STAGE_TIME_COLUMNS = [
    ("signup", "signup_at"),
    ("profile_started", "profile_started_at"),
    ("profile_completed", "profile_completed_at"),
    ("verification_submitted", "verification_submitted_at"),
    ("verification_approved", "verification_approved_at"),
    ("verification_rejected", "verification_rejected_at"),
    ("first_engagement_completed", "first_engagement_at"),
]

# report stage, its order, and the reached flag that counts it
REPORT_STAGES = [
    ("signup", 1, "reached_signup"),
    ("profile_started", 2, "reached_profile_started"),
    ("profile_completed", 3, "reached_profile_completed"),
    ("verification_submitted", 4, "reached_verification_submitted"),
    ("verified", 5, "reached_verified"),
    ("activated", 6, "reached_activated"),
]

# canonical step transitions (from_step, to_step); the destination names the
# report stage it feeds (rejected has no report stage)
STEP_PAIRS = [
    ("signup", "profile_started"),
    ("profile_started", "profile_completed"),
    ("profile_completed", "verification_submitted"),
    ("verification_submitted", "verification_approved"),
    ("verification_submitted", "verification_rejected"),
    ("verification_approved", "first_engagement_completed"),
]

# destination event -> report stage of the step analysis
STEP_DEST_STAGE = [
    ("profile_started", "profile_started"),
    ("profile_completed", "profile_completed"),
    ("verification_submitted", "verification_submitted"),
    ("verification_approved", "verified"),
    ("first_engagement_completed", "activated"),
]

PAID_CHANNELS = ["paid_search", "paid_social", "linkedin_outreach"]
UNPAID_CHANNELS = ["organic", "referral", "unknown"]
SIGNUP_SOURCES = ["paid_search", "paid_social", "organic", "referral", "linkedin_outreach", "unknown"]
EVENT_NAMES = [
    "signup",
    "profile_started",
    "profile_completed",
    "verification_submitted",
    "verification_approved",
    "verification_rejected",
    "first_engagement_completed",
]
ENGAGEMENT_TYPES = ["survey", "interview"]

# --- parameters with the reference's defaults --------------------------------

SESSION_GAP_MINUTES = 1440  # a gap strictly above this starts a session
ACTIVATION_WINDOW_DAYS = 60  # activation counts when days_to_activate <= this
MIN_SIGNUPS_FOR_RATE_RANK = 100
TOP_K = 3
Z_THRESHOLD = 1.96
PERIOD_A = ("2024-07-01", "2024-09-30")  # Q3 2024
PERIOD_B = ("2024-10-01", "2024-12-31")  # Q4 2024
NULL_UTM_THRESHOLD = 0.05
TIMESTAMP_ORDER_THRESHOLD = 0.05
NULL_PAYOUT_THRESHOLD = 0.01
BEFORE_SIGNUP_LIMIT = 50
UNKNOWN_PROFILE_LIMIT = 20
QUANTILES = (0.5, 0.75, 0.9)
