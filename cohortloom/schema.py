"""Entity schemas.

Column names are the CRM field names in snake case without the custom-field
suffix (``Status_Change_Reason__c`` -> ``status_change_reason``).
``normalise_fields`` renames a raw extract by that rule; fields that carry a name
or abbreviation of the organisation lose it through ``org``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def field_name(raw: str, org: str | Iterable[str] = ()) -> str:
    """Library name of one raw CRM field."""
    name = re.sub(r"__p?c$", "", raw.strip())
    for token in [org] if isinstance(org, str) else org:
        name = re.sub(rf"(^|_){re.escape(token)}(?=_|$)", r"\1", name, flags=re.IGNORECASE)
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    return re.sub(r"_+", "_", name).strip("_").lower()


def normalise_fields(df: DataFrame, org: str | Iterable[str] = ()) -> DataFrame:
    """Rename every column of a raw extract to its library name."""
    names = [field_name(c, org) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"fields collapse to the same name: {clashes}")
    return df.toDF(*names)


# Column lists, one block per type. Fixed values.
_ENTITIES = {
    "case": {
        "string": """
            id account_id case_number origin status status_change_reason i_am
            what_can_help_you_with utm_term utm_campaign utm_content
            any_thoughts_of_killing_yourself thoughts_of_killing_yourself_right_now
            wished_you_were_dead_past_month thoughts_of_killing_yourself_past_month
            thinking_about_how_you_might_do_this thoughts_intention_of_acting_on_them
            details_of_how_intend_to_carry_out done_started_prepared_to_end_your_life
            done_started_prepared_last_3_months int_ckl_chronic_pain
            int_ckl_physical_heath_issues int_ckl_physical_health_treatment
            int_ckl_mental_health_issues int_ckl_mental_health_treatment
            int_ckl_substance_abuse int_ckl_peer_support int_ckl_receiving_care_at_vha
            owner_id most_recent_overall_risk_level most_recent_chronic_risk_level
            most_recent_acute_risk_level recent_crp_warning_signs
            recent_crp_self_help_actions recent_crp_reasons_for_living
            recent_crp_social_support recent_crp_professional_support
            recent_crp_plan_storage recent_crp_means_reduction""",
        "timestamp": "created_date last_connection_date_time",
    },
    "account": {
        "string": """
            id name health_cloud_ga_age health_cloud_ga_gender assigned_sex_at_birth race
            ethnicity service_status homeless int_ckl_domestic_violence
            int_ckl_employment_status int_ckl_health_insurance
            health_cloud_ga_last_active_case_ir
            health_cloud_ga_lst_act_case_current_risk_lvll""",
        "timestamp": "created_date",
        "boolean": "test_account",
    },
    "case_note": {
        "string": """
            id case case_note_type call_center_type connection_outcome session_type
            interaction_with_whom overall_risk_level acute_risk_level chronic_risk_level
            risk_level_change_reason history_of_chronic_ideation
            history_of_self_directed_violence history_of_attempts
            chronic_major_mental_diagnosis chronic_major_personality_diagnosis
            history_of_substance_misuse_abuse chronic_major_medical_diagnosis chronic_pain
            limited_coping_skills_chronic unstable_psychosocial_status
            limited_reasons_for_living history_of_risky_actions history_of_impulsivity
            current_suicidal_ideation_even_passive inability_to_stay_safe
            intent_or_wish_to_die set_method_of_choice_or_plan recent_attempt
            more_than_one_attempt ongoing_preparatory_behavior will_not_use_crp
            limited_coping_skills_acute access_to_means acute_major_illness
            intensified_personality_disorder acute_psychosocial_stressors
            lookup_primary_phone_call lookup_secondary_phone_call
            lookup_tertiary_phone_call""",
        "timestamp": "created_date interaction_date_time",
    },
    "form": {
        "string": """
            id care_plan name account cp_contact_level cp_contact_monitoring_level
            cp_safety_plan cp_lethal_means_reduction coq_self_rated_risk
            coq_manage_thoughts_and_feelings coq_fleeting_thoughts coq_current_thoughts
            suicidality_subscale_group_1 suicidality_subscale_group_2
            suicidality_subscale_group_3 suicidality_subscale_group_4
            coq_f_prevent_attempt coq_f_prevent_attempt_details
            coq_f_consent_for_attempt_details fss_share_with_others_txt
            fss_consent_to_share fss_learned_from_txt fss_improvement_txt
            coq_b_talked_about_suicide coq_b_talked_about_suicide_who
            coq_b_talked_about_suicide_other crisis_crisis_reasons crisis_suicide_timing
            aborted_suicide_prep interrupted_prep recent_suicide_attempt impact
            stopper_details crp_firearms_access crp_safe_lockbox_usage
            crp_firearms_loaded iia_outcome iia_alternate_methods
            iia_similar_trigers_or_methods""",
        "timestamp": "created_date",
        "date": "cp_plan_enacted_date cp_contingency_end_date crisis_date_crisis_occurred",
        "int": """
            future_optimism feeling_useful relaxation problem_handling clear_thinking
            social_closeness independent_decisions bscs_self_worth bscs_problem_help
            bscs_coping_struggle bscs_enduring_pain bscs_self_redeeming
            bscs_suicide_thoughts cams_rate_psychological_pain cams_rate_stress
            cams_rate_agitation cams_rate_hopelessness cams_rate_self_hate
            cams_rate_overall_suicide_risk fss_nps_question""",
    },
    "contact_analytics": {"string": "id amazonconnect_contact_lens_transcripts_full_text"},
    "owner": {"string": "id name username"},
    "survey": {"int": "year", "string": "question", "double": "percentage se ci_lower ci_upper"},
}

_TYPES = {
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
}


def entity_schema(name: str) -> T.StructType:
    """``StructType`` of an entity; only ``id`` is not nullable."""
    return T.StructType(
        [
            T.StructField(column, _TYPES[kind], column != "id")
            for kind, columns in _ENTITIES[name].items()
            for column in columns.split()
        ]
    )


def entities() -> list[str]:
    return list(_ENTITIES)
