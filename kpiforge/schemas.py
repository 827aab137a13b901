"""Table schemas, column width limits and fixed reference values."""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, TS, D = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType(), T.DateType()


def _struct(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


VISITS = _struct(
    ("id", L), ("visitor_id", S), ("user_id", L), ("is_registered", I), ("page_path", S),
    ("page_pattern", S), ("page_title", S), ("referrer", S), ("country_code", S), ("region_code", S),
    ("region_name", S), ("city", S), ("device_type", S), ("browser", S), ("os", S), ("session_key", S),
    ("visited_at", TS),
)
SEARCH_LOG = _struct(
    ("id", L), ("visitor_id", S), ("user_id", L), ("term", S), ("term_norm", S), ("results_cnt", L),
    ("page_path", S), ("country_code", S), ("region_name", S), ("searched_at", TS),
)
REGIONS = _struct(("code", S), ("name", S))
USERS = _struct(
    ("id", L), ("email", S), ("full_name", S), ("username", S), ("avatar", S), ("user_type", S),
    ("account_status", S), ("password_hash", S), ("phone", S), ("gender", S), ("country", S),
    ("city", S), ("university", S), ("degree", S), ("research_field", S), ("specialty", S),
    ("birth_date", D), ("registered_at", TS), ("last_login_at", TS),
)
SESSIONS = _struct(
    ("session_id", L), ("user_id", L), ("token", S), ("refresh_token", S), ("expires_at", TS),
    ("refresh_expires_at", TS), ("is_active", I), ("created_at", TS), ("last_used_at", TS),
    ("ip_address", S),
)
SUBSCRIBERS = _struct(
    ("id", L), ("email", S), ("full_name", S), ("user_id", L), ("status", S), ("confirm_token", S),
    ("source", S), ("subscribed_at", TS), ("unsubscribed_at", TS),
)
CAMPAIGNS = _struct(
    ("id", L), ("subject", S), ("body_html", S), ("status", S), ("recipients", L), ("sent_count", L),
    ("fail_count", L), ("created_at", TS), ("sent_at", TS), ("created_by", S),
)
SEND_LOG = _struct(("id", L), ("campaign_id", L), ("email", S), ("status", S), ("error_msg", S), ("sent_at", TS))
CATEGORIES = _struct(("code", S), ("name", S), ("icon", S), ("color", S), ("display_order", I))
ACHIEVEMENTS = _struct(
    ("id", L), ("year_no", I), ("category", S), ("title", S), ("summary", S), ("figure_value", S),
    ("figure_label", S), ("source_url", S), ("is_featured", I), ("display_order", I),
    ("is_published", I), ("created_at", TS),
)
VISIT_EVENT = _struct(
    ("event_id", L), ("received_at", TS), ("token", S), ("country", S), ("region", S), ("visitor_id", S),
    ("path", S), ("pattern", S), ("title", S), ("referrer", S), ("city", S), ("device", S),
    ("browser", S), ("os", S), ("session_key", S),
)
SEARCH_EVENT = _struct(
    ("event_id", L), ("received_at", TS), ("token", S), ("country", S), ("region", S), ("visitor_id", S),
    ("term", S), ("results", L), ("path", S),
)
CLAIMS = _struct(
    ("aud", S), ("iss", S), ("email", S), ("email_verified", S), ("name", S), ("picture", S), ("sub", S),
)
ACTIONS = _struct(
    ("seq", L), ("ts", TS), ("action", S), ("email", S), ("token", S), ("id", L), ("name", S), ("status", S),
)
RESPONSES = _struct(("campaign_id", L), ("email", S), ("http_code", I), ("body", S), ("error", S))

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the source system's for equal results.
# ---------------------------------------------------------------------------
# Regions of the home country: ISO 3166-2 numeric code and English name.
# Thirteen rows; code 13 does not exist.
HOME_REGIONS = [
    ("01", "Riyadh"),
    ("02", "Makkah"),
    ("03", "Madinah"),
    ("04", "Eastern Province"),
    ("05", "Qassim"),
    ("06", "Hail"),
    ("07", "Tabuk"),
    ("08", "Northern Borders"),
    ("09", "Jazan"),
    ("10", "Najran"),
    ("11", "Al Bahah"),
    ("12", "Al Jawf"),
    ("14", "Asir"),
]

# Achievement categories: code, English name, icon, colour, display order.
ACHIEVEMENT_CATEGORIES = [
    ("international", "International participation", "Globe", "#1e5f8f", 10),
    ("local", "Local participation and volunteering", "HeartHandshake", "#1f7a6c", 20),
    ("awards", "Global awards", "Trophy", "#96774f", 30),
    ("patents", "Patents", "Lightbulb", "#8a5a2b", 40),
    ("scholars", "Scholarship students", "GraduationCap", "#4a4a8f", 50),
    ("sports", "Sports", "Medal", "#1d6b45", 60),
    ("business", "Entrepreneurship", "Rocket", "#a1421f", 70),
    ("initiatives", "Empowerment initiatives", "Sparkles", "#1e2a52", 80),
    ("nonprofit", "Nonprofit sector", "Building2", "#5b4a7a", 90),
]
DEFAULT_YEAR = 2025

# Gender spellings folded by the user KPIs (the series keeps raw values).
MALE_SPELLINGS = ["ذكر", "Male", "male", "M"]
FEMALE_SPELLINGS = ["أنثى", "Female", "female", "F"]

# Age buckets: (rank, label, lowest age, highest age); None = open end.
AGE_BUCKETS = [
    (1, "under 18", None, 17),
    (2, "18 - 24", 18, 24),
    (3, "25 - 34", 25, 34),
    (4, "35 - 44", 35, 44),
    (5, "45+", 45, None),
]
UNSPECIFIED = "unspecified"

# Claims check (sign-in): accepted issuers.
GOOGLE_ISSUERS = ["accounts.google.com", "https://accounts.google.com"]

# Session lifetimes opened by a sign-in.
SESSION_DAYS, REFRESH_DAYS = 30, 60

# Subscriber statuses the fold can represent.
SUBSCRIBER_STATUSES = ["active", "unsubscribed"]
