"""Declared schemas of the survey feeds (DDL text); files are read with these, never inferred."""

from __future__ import annotations


def field_names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(",")]


CHECKLIST_OBSERVATIONS = (
    "checklist_id string, sampling_event_identifier string, group_identifier string, scientific_name string, "
    "observation_count string, country string, state string, county string, locality_id string, "
    "observer_id string, observation_date date, observation_type string, duration_minutes int, "
    "effort_distance_km double, effort_area_ha double, number_observers int, breeding_category string, "
    "age_sex string, longitude double, latitude double"
)
CHECKLISTS = (
    "sampling_event_identifier string, group_identifier string, observer_id string, observation_date date, "
    "observation_type string, duration_minutes int, effort_distance_km double, number_observers int, "
    "all_species_reported boolean, longitude double, latitude double"
)
ROUTES = (
    "country_num int, state_num int, route int, route_name string, active int, stratum int, bcr int, "
    "longitude double, latitude double"
)
ROUTE_COUNTS = (
    "aou int, country_num int, state_num int, route int, year int, obs_n int, "
    + ", ".join(f"stop{i} int" for i in range(1, 51))
)
DISTANCE_SURVEY = (
    "transect_num string, transect_visit_observer string, radial_distance double, cl_count int, "
    "point_visit_start_time string, point_latitude double, point_longitude double, species string, "
    "bird_code string, date date, year int, county string, state string, point int, time_period int"
)
POSTERIOR_DRAWS = ("chain int, iter bigint, parameter string, value double")
