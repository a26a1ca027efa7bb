"""Rule constants and job parameters.

The literal lists are fixed values: they must equal the picklist values of the
source system for the rules to hold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: exclusion lists -------------------------------------------
THIRD_PARTY_REASONS = (
    "Third Party - Did Not Convert Client",
    "Third Party - Converted Client",
)
INELIGIBLE_REASONS = (
    "Duplicate Case for Active Client",
    "Test Case",
    "Ineligible - Not a Service Member/Veteran",
    "Ineligible - Underage",
)
NOT_ESTABLISHED_REASONS = (
    "Declined Services At Intake",
    "Declined Services At Scheduling",
    "Unable to Contact - Intake Not Completed, Client Nonconnection",
    "Caring Contacts - Ongoing",
)
SCORING_EXCLUDED_REASONS = (
    *THIRD_PARTY_REASONS,
    *INELIGIBLE_REASONS,
    *NOT_ESTABLISHED_REASONS,
    "Caring Contacts - Completed",
    "Caring Contacts - Client Returned to Care",
    "Caring Contacts - Client Opted Out",
)
TREATMENT_EXCLUDED_REASONS = (*SCORING_EXCLUDED_REASONS, "Referred to External Provider")
DEATH_REASON = "Died by Suicide"

# --- fixed values: picklist literals -----------------------------------------
CONNECTED = "Connected by Phone, Video, SMS Conversation, or Email Conversation"
SELF_REQUEST = "I am a veteran/service member seeking help"
THIRD_PARTY_REQUEST = "I am requesting help for a veteran/service member"
THIRD_PARTY_CONTACT = "3rd Party Client"
DUPLICATE_CALL = "Did not call / duplicate help request"
INBOUND_CALL = "Inbound call"
ACTIVE_STATUS = "Active_In_Care"
NOTE_TYPES = ("Session", "General", "RRBC")
TEST_NAME_TOKENS = ("TEST", "RRBC")
RISK_LABELS = {"HRC": "1. HRC", "MRC": "2. MRC", "LRC": "3. LRC"}
UNKNOWN = "Unknown / Prefer Not to Say"

# --- fixed values: multi-select tokens, name suffix -> substring --------------
HELP_TOPICS = {
    "sleep": "Sleep", "trauma": "Trauma", "abuse": "Abuse", "tbi": "TBI",
    "addictions": "Addictions", "relationships": "Relationships", "finances": "Finances",
    "housing": "Housing", "chronicpain": "Chronic Pain", "hopelessness": "Hopelessness",
    "trapped": "Feeling Trapped", "anxiety": "Anxiety", "isolation": "Isolation",
    "guilt": "Guilt", "selfhate": "Self-hate", "anguish": "Anguish/Misery",
    "grief": "Grief/Loss", "anger": "Anger", "trust": "Trust",
    "purpose": "Life Purpose", "other": "Other",
}
EMPLOYMENT = {
    "disabled": "Disabled", "looking": "Looking for work",
    "notempl": "Not currently employed", "retired": "Retired",
    "fulltime": "Working full time for pay", "parttime": "Working part time for pay",
    "other": "Other",
}
TALKED_TO = {
    "friends": "Friend/s", "family": "Family member/s",
    "va": "Veterans Health Administration or the VA",
    "vamhprovider": "VA mental health provider",
    "dodmhprovider": "DoD mental health provider",
    "othermhprovider": "Mental health provider outside of the VA or DoD",
    "chainofcommand": "Current or prior chain of command in the military",
    "smsinunit": "Other service members in your unit",
    "othervso": "Other veteran serving organization/s",
    "ehp": "Employee health program", "militaryonesource": "Military OneSource",
    "vcl": "Veterans Crisis Line", "othercrisisline": "Other crisis line",
    "religiousleader": "Religious leader or affiliate", "other": "Other;",
}
RACE_MAP = {
    "Black or African American": "Black or African American",
    "Black or African American;Nonwhite": "Black or African American",
    "White": "White or Caucasian",
}
AGE_BANDS = (
    (18, 34, "18 to 34 Years"),
    (35, 54, "35 to 54 Years"),
    (55, 74, "55 to 74 Years"),
    (75, None, "75+ Years"),
)
GENDERS = ("Man", "Woman", "Other")
ETHNICITY_REFUSED = ("Prefer Not to Say", "Unknown")
YES_NO_COLUMNS = {
    "homeless": "homeless", "dv": "int_ckl_domestic_violence",
    "healthinsurance": "int_ckl_health_insurance", "chronicpain": "int_ckl_chronic_pain",
    "physicaltx": "int_ckl_physical_health_treatment",
    "mentaltx": "int_ckl_mental_health_treatment",
    "substanceabuse": "int_ckl_substance_abuse", "peersupport": "int_ckl_peer_support",
    "vhacare": "int_ckl_receiving_care_at_vha",
}

# --- fixed values: questionnaires --------------------------------------------
PLAN_PARTS = (
    "recent_crp_warning_signs", "recent_crp_self_help_actions",
    "recent_crp_reasons_for_living", "recent_crp_social_support",
    "recent_crp_professional_support", "recent_crp_plan_storage",
    "recent_crp_means_reduction",
)
WELLBEING_ITEMS = (
    "future_optimism", "feeling_useful", "relaxation", "problem_handling",
    "clear_thinking", "social_closeness", "independent_decisions",
)
COGNITION_ITEMS = (
    "bscs_self_worth", "bscs_problem_help", "bscs_coping_struggle",
    "bscs_enduring_pain", "bscs_self_redeeming", "bscs_suicide_thoughts",
)
SESSION_RATINGS = (
    "cams_rate_psychological_pain", "cams_rate_stress", "cams_rate_agitation",
    "cams_rate_hopelessness", "cams_rate_self_hate", "cams_rate_overall_suicide_risk",
)
FORM_CONTINGENCY = "Contingency Plan"
FORM_SESSION_BASELINE = "CAMS Initial Session"
FORM_SESSIONS = (FORM_SESSION_BASELINE, "CAMS Interim Session", "CAMS Final Session")
FORM_BASELINE = "Baseline Core Outcomes Questionnaire"
FORM_FOLLOWUP = "Follow-up Core Outcomes Questionnaire"
FORM_COGNITION = "Brief Suicide Cognitions Scale (B-SCS)"
FORM_INTAKE_LITE = "Checklist: Intake Lite"
FORM_FEEDBACK = "Feedback Survey"
FORM_RESPONSE_PLAN = "Crisis Response Plan (CRP)"

# --- fixed values: bins and score ramps --------------------------------------
DAY_BINS = (
    (0, "0. Baseline"), (30, "1-30 Days"), (60, "31-60 Days"), (90, "61-90 Days"),
    (120, "91-120 Days"), (150, "121-150 Days"), (180, "151-180 Days"),
    (None, "181+ Days"),
)
CRISIS_PHRASES = ("Lethal Means in Hand", "Active Attempt", "Suicidal Gestures")
CRISIS_TIMINGS = ("within the next day", "within 7 days", "within 30 days")


@dataclass(frozen=True)
class Ramp:
    """Score that grows linearly over ``months`` from ``start`` and then stays at ``full``."""

    full: float
    slope: float
    start: float
    months: float


HIGH_RAMP = Ramp(full=0.16, slope=0.08, start=0.08, months=12)
MODERATE_RAMP = Ramp(full=0.04, slope=0.03, start=0.01, months=12)
COGNITION_RAMP = Ramp(full=0.24, slope=0.20, start=0.04, months=6)
COGNITION_CUTOFF = 13
STORAGE_SCORES = {"both": 0.82, "unloaded": 0.77, "locked": 0.72}


@dataclass(frozen=True)
class CohortParams:
    """Everything a cohort run may change."""

    start: str
    end: str
    note_types: tuple[str, ...] = NOTE_TYPES
    connected: str = CONNECTED
    test_tokens: tuple[str, ...] = TEST_NAME_TOKENS
    active_status: str = ACTIVE_STATUS
    third_party_contact: str = THIRD_PARTY_CONTACT
    treatment_excluded: tuple[str, ...] = TREATMENT_EXCLUDED_REASONS
    scoring_excluded: tuple[str, ...] = SCORING_EXCLUDED_REASONS


@dataclass(frozen=True)
class IndicatorParams:
    """Choices in the score where written rule and stated intent differ."""

    # 'last': the 30-day rule binds to the last crisis phrase only; 'all': to every phrase.
    date_rule: str = "last"
    # 'not_no': attempt with impact other than "No"; 'no': attempt with impact "No".
    no_impact_rule: str = "not_no"
    # 'as_written' never fires; 'intended' compares the latest plan with the latest unsafe one.
    storage_mode: str = "as_written"
    staff_label: str = "Staff"
    death_reason: str = DEATH_REASON
    crisis_phrases: tuple[str, ...] = field(default=CRISIS_PHRASES)
    crisis_timings: tuple[str, ...] = field(default=CRISIS_TIMINGS)
