"""Declared schemas; nothing is inferred from file contents."""

from __future__ import annotations

# fixed values: column headers of the landed admission and location sheets
ADMISSION_HEADERS = {
    "Site": "site", "Period": "period", "month adm": "adm_month", "year adm": "adm_year", "gender": "sex",
    "Age years": "age_years", "Age mths": "age_months", "temp": "temperature", "fever": "fever",
    "Fever days": "fever_days", "convulsions": "convulsions", "Fits/24HRS": "fits_per_24h",
    "Nasal Flaring": "nasal_flaring", "Inter costal recession": "intercostal_recession",
    "deep breathing": "deep_breathing", "unconscious observed": "unconscious", "APVU": "apvu", "BCS": "bcs",
    "pallor": "pallor", "hblevel": "hb_level", "bloodtransfusion": "transfusion", "AD": "outcome", "SMA": "sma",
}
LOCATION_HEADERS = {
    "Country": "country", "Site": "site", "Dates": "period", "Dates of PR data": "pr_dates",
    "Method used": "detection_method", "Lat community": "latitude", "Long community": "longitude", "HbAS": "hbas",
    "Min dist to hospital": "hospital_min_dist", "Max distance to hospital": "hospital_max_dist",
    "ITN coverage": "itn", "IRS": "irs", "Av an. rainfall in period": "rainfall", "Altitude MaSL": "altitude",
    "Age corrected PR 2-10": "pr_c", "Number examined": "n_examined", "Number PF positive": "n_positive",
}

ADMISSIONS_RAW = """
    site STRING, period STRING, adm_month INT, adm_year INT, sex STRING, age_years INT, age_months DOUBLE,
    temperature DOUBLE, fever STRING, fever_days DOUBLE, convulsions STRING, fits_per_24h DOUBLE,
    nasal_flaring STRING, intercostal_recession STRING, deep_breathing STRING, unconscious STRING,
    apvu STRING, bcs INT, pallor STRING, hb_level DOUBLE, transfusion STRING, outcome STRING, sma STRING
"""

ADMISSIONS = """
    site STRING, period STRING, adm_month INT, adm_year INT, sex STRING, age_years INT, age_months DOUBLE,
    temperature DOUBLE, fever STRING, fever_days DOUBLE, convulsions BOOLEAN, fits_per_24h DOUBLE,
    nasal_flaring BOOLEAN, intercostal_recession BOOLEAN, deep_breathing BOOLEAN, unconscious BOOLEAN,
    apvu STRING, bcs INT, pallor STRING, hb_level DOUBLE, transfusion BOOLEAN, outcome STRING, sma STRING
"""

LOCATIONS_RAW = """
    country STRING, site STRING, period STRING, pr_dates STRING, detection_method STRING, latitude DOUBLE,
    longitude DOUBLE, hbas DOUBLE, hospital_min_dist DOUBLE, hospital_max_dist DOUBLE, itn DOUBLE, irs STRING,
    rainfall DOUBLE, altitude DOUBLE, pr_c DOUBLE, n_examined BIGINT, n_positive BIGINT
"""

POPULATION_PART = "age STRING, pyor DOUBLE"

COMPLETE = (
    ADMISSIONS
    + """,
    country STRING, pr_dates STRING, detection_method STRING, latitude DOUBLE, longitude DOUBLE, hbas DOUBLE,
    hospital_min_dist DOUBLE, hospital_max_dist DOUBLE, itn DOUBLE, irs BOOLEAN, rainfall DOUBLE, altitude DOUBLE,
    pr_c DOUBLE, n_examined BIGINT, n_positive BIGINT, pr DOUBLE, r DOUBLE, n_age DOUBLE, total_population DOUBLE
"""
)

SURVEYS_RAW = "site STRING, period STRING, min_age DOUBLE, max_age DOUBLE, number BIGINT, positives BIGINT"

SURVEYS = """
    study_number BIGINT, study_id STRING, site STRING, country STRING, period STRING, min_age INT, max_age INT,
    number BIGINT, positives BIGINT, detection_method STRING
"""

DRAWS_LONG = "chain INT, iteration BIGINT, parameter STRING, idx INT, value DOUBLE, model STRING"

SCORES = "model STRING, d_bar DOUBLE, p_d DOUBLE, dic DOUBLE, phenotype STRING"
