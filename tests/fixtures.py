"""Small entity tables with missing values; every column not given is missing."""

from __future__ import annotations

import datetime as dt

from cohortloom import params as P
from cohortloom.schema import entity_schema

START, END = "2023-12-01T05:00:00Z", "2024-03-01T05:00:00Z"
PARAMS = P.CohortParams(start=START, end=END)


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def entity(spark, name: str, records: list[dict]):
    schema = entity_schema(name)
    unknown = {k for r in records for k in r} - set(schema.names)
    if unknown:
        raise ValueError(f"{name}: no such columns {sorted(unknown)}")
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in records], schema)


def case(id, account="A", created="2024-01-10 12:00", **kw):
    return {"id": id, "account_id": account, "case_number": f"N{id}", "created_date": at(created), "i_am": P.SELF_REQUEST,
            "status": P.ACTIVE_STATUS, **kw}


def account(id, **kw):
    return {"id": id, "name": f"Person {id}", "created_date": at("2023-01-01 00:00"), "test_account": False, **kw}


def note(id, case, when="2024-01-11 12:00", **kw):
    return {"id": id, "case": case, "created_date": at(when) if when else None, "interaction_date_time": at("2024-01-11 12:00"),
            "case_note_type": "Session", "connection_outcome": P.CONNECTED, **kw}


def form(id, case, name, when="2024-01-15 12:00", **kw):
    return {"id": id, "care_plan": case, "name": name, "created_date": at(when), **kw}
