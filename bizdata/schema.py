"""Canonical table schemas.  Tables are always read with these, never by inference."""

from pyspark.sql import types as T

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_D, _TS, _F = T.DateType(), T.TimestampNTZType(), T.DoubleType()


def _dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


COMPANIES = _table(
    id=_S, company_number=_S, name=_S, legal_name=_S, jurisdiction=_S, company_type=_S, status=_S,
    incorporation_date=_D, address_line_1=_S, address_line_2=_S, locality=_S, region=_S,
    postal_code=_S, country=_S, website=_S, phone=_S, email=_S, linkedin_url=_S, description=_S,
    industry=_S, employee_count=_I, annual_revenue=_dec(20, 2), data_source=_S,
    enrichment_status=_S, last_enriched=_TS, notes=_S, registration_number=_S, quality_score=_I, last_verified=_TS, last_updated=_TS, created_at=_TS,
)
OFFICERS = _table(
    id=_S, company_id=_S, name=_S, role=_S, appointed_date=_D, resigned_date=_D, nationality=_S,
    occupation=_S, date_of_birth=_D, address=_S, created_at=_TS,
)
OFFICER_APPOINTMENTS = _table(
    company_id=_S, officer_id=_S, officer_role=_S, appointed_on=_D, resigned_on=_D,
    appointment_type=_S, is_active=_B, ch_links=_S,
)
COMPANY_CONTACTS = _table(
    id=_S, company_id=_S, contact_type=_S, value=_S, is_verified=_B, source=_S, created_at=_TS,
)
TRACKING_HISTORY = _table(id=_S, company_id=_S, source=_S, status=_S, data_found=_S, tracked_at=_TS)
SEARCH_LOGS = _table(
    id=_S, search_query=_S, filters=_S, results_count=_I, user_session=_S, searched_at=_TS)
ACCOUNTS = _table(
    account_id=_L, company_name=_S, industry=_S, company_category=_S, company_size=_S, revenue=_S,
    country=_S, state_region=_S, city=_S, district=_S, ward=_S, address=_S, website=_S,
    phone_number=_S, email_format=_S, linkedin_url=_S, twitter_url=_S, facebook_url=_S,
    instagram_url=_S, employee_count=_I, rating=_dec(2, 1), quality_score=_I, verified=_B,
    data_source=_S, created_at=_TS, updated_at=_TS,
)
CONTACTS = _table(
    contact_id=_L, linked_account_id=_L, first_name=_S, last_name=_S, job_title=_S, email=_S,
    phone_number=_S, linkedin_url=_S, country=_S, city=_S, connection_degree=_S, seniority=_S,
    industry_hint=_S, email_format_guess=_S, email_generated=_B, phone_formatted=_S, email_verified=_B, phone_verified=_B, data_source=_S, verified=_B,
    is_primary=_B, confidence_score=_I, created_at=_TS, updated_at=_TS,
)
COUNTRIES = _table(country_id=_I, country_code=_S, country_name=_S)
STATES = _table(state_id=_I, country_id=_I, state_code=_S, state_name=_S)
CITIES = _table(
    city_id=_I, state_id=_I, country_id=_I, city_name=_S, latitude=_dec(10, 8),
    longitude=_dec(11, 8), population=_I)
DISTRICTS = _table(district_id=_I, city_id=_I, district_name=_S)
COMPANY_HISTORY = _table(company_id=_S, field_name=_S, old_value=_S, new_value=_S, changed_at=_TS)
DATA_SOURCES = _table(company_id=_S, source_name=_S, source_url=_S, reliability=_I, last_checked=_TS)
UPDATE_LOG = _table(
    update_id=_S, update_type=_S, source=_S, status=_S, records_processed=_L, records_added=_L,
    records_updated=_L, records_failed=_L, started_at=_TS, completed_at=_TS,
)
CONTACT_VALIDATIONS = _table(
    contact_id=_L, email_valid=_B, email_score=_I, email_reason=_S, phone_valid=_B,
    validated_at=_TS,
)
COMPANY_DUPLICATES = _table(
    primary_id=_S, duplicate_id=_S, match_reason=_S, match_confidence=_dec(3, 2), status=_S)
COMPLETED_AREAS = _table(
    country=_S, state_region=_S, city=_S, district=_S, postcode=_S, companies_found=_I,
    contacts_found=_I, sources_used=T.ArrayType(_S), completed_at=_TS,
)
DISCOVERY_QUEUE = _table(
    queue_id=_L, country=_S, country_code=_S, state_region=_S, state_code=_S, city=_S,
    place_type=_S, population=_L, latitude=_F, longitude=_F, priority=_I, status=_S,
    companies_found=_I, started_at=_TS, completed_at=_TS, error_message=_S,
)
ENRICHMENT_QUEUE = _table(
    queue_id=_S, company_id=_S, priority=_I, status=_S, attempts=_I, max_attempts=_I,
    worker_id=_S, error_message=_S, scheduled_for=_TS, started_at=_TS, completed_at=_TS,
    created_at=_TS, updated_at=_TS,
)
ENRICHMENT_LOGS = _table(
    log_id=_L, company_id=_S, status=_S, notes=_S, processing_time_ms=_L, created_at=_TS)
PAGES = _table(page_id=_L, url=_S, html=_S)
DOMAIN_FACTS = _table(email=_S, mx_count=_I, smtp_result=_S, catch_all=_B)

TABLES: dict[str, T.StructType] = {
    "companies": COMPANIES, "officers": OFFICERS, "officer_appointments": OFFICER_APPOINTMENTS,
    "company_contacts": COMPANY_CONTACTS, "tracking_history": TRACKING_HISTORY,
    "search_logs": SEARCH_LOGS, "accounts": ACCOUNTS, "contacts": CONTACTS,
    "countries": COUNTRIES, "states": STATES, "cities": CITIES, "districts": DISTRICTS,
    "company_history": COMPANY_HISTORY, "data_sources": DATA_SOURCES, "update_log": UPDATE_LOG,
    "contact_validations": CONTACT_VALIDATIONS, "company_duplicates": COMPANY_DUPLICATES,
    "completed_areas": COMPLETED_AREAS, "discovery_queue": DISCOVERY_QUEUE,
    "enrichment_queue": ENRICHMENT_QUEUE, "enrichment_logs": ENRICHMENT_LOGS, "pages": PAGES,
    "domain_facts": DOMAIN_FACTS,
}
