"""A small invented catalog for demonstrations and tests."""

from __future__ import annotations

from datetime import date, datetime

_T = datetime(2021, 5, 1, 12, 0)


def _person(n: int, **more: object) -> dict[str, object]:
    return {"id": f"p{n}", "slug": f"person-{n}", "status": "published", "confidence": "high", "created_at": _T, "updated_at": _T} | more


def _work(n: int, **more: object) -> dict[str, object]:
    return {"id": f"w{n}", "slug": f"work-{n}", "status": "published", "confidence": "high", "created_at": _T, "updated_at": _T} | more


DEMO_ROWS: dict[str, list[dict[str, object]]] = {
    "people": [
        _person(1, primary_name="灯野硯", name_zh="灯野砚", name_ja="灯野硯", name_en="Suzuri Tomono", active=True, biography="石畳の町に住む。"),
        _person(2, primary_name="Nagi Kaede", name_en="Nagi Kaede", active=False),
        _person(3, primary_name="霧島波", active=None),
        _person(4, primary_name="Hidden One", status="draft", active=True),
    ],
    "person_aliases": [
        {"id": "a1", "person_id": "p1", "name": "トモノ スズリ", "is_primary": False, "created_at": _T},
        {"id": "a2", "person_id": "p1", "name": "Suzu Tomono", "is_primary": False, "created_at": _T},
        {"id": "a3", "person_id": "p3", "name": "", "is_primary": False, "created_at": _T},
    ],
    "career_events": [
        {"id": "e1", "person_id": "p1", "type": "debut", "event_date": date(2012, 3, 1), "note": "初舞台", "created_at": _T},
        {"id": "e2", "person_id": "p1", "type": "hiatus", "event_date": date(2015, 1, 1), "created_at": _T},
        {"id": "e3", "person_id": "p2", "type": "retirement", "event_date": None, "created_at": _T},
    ],
    "organizations": [{"id": "o1", "slug": "lamp", "type": "maker", "name": "Lamp House", "name_zh": "灯屋", "created_at": _T}, {"id": "o2", "slug": "bare", "type": "maker", "name": "Bare Works", "created_at": _T}],
    "works": [
        _work(1, title_original="水の階段", title_zh="水之阶梯", synopsis="静かな話。"),
        _work(2, title_original="Amber Rooms"),
        _work(3, title_original="無番地"),
        _work(4, title_original="Draft Piece", status="draft"),
    ],
    "releases": [
        {"id": "r1", "work_id": "w1", "code": "AB-001", "release_date": date(2020, 1, 5), "runtime_minutes": 90, "medium": "digital", "distributor_id": "o1"},
        {"id": "r2", "work_id": "w1", "code": "AB-002", "release_date": None, "runtime_minutes": 95, "medium": "physical", "distributor_id": "o2"},
        {"id": "r3", "work_id": "w2", "code": "CD-010", "release_date": None, "runtime_minutes": None, "medium": None, "distributor_id": None},
    ],
    "credits": [
        {"work_id": "w1", "person_id": "p1", "credit_type": "performer", "billing_order": 2},
        {"work_id": "w1", "person_id": "p2", "credit_type": "performer", "billing_order": 1},
        {"work_id": "w1", "person_id": "p4", "credit_type": "performer", "billing_order": 3},
        {"work_id": "w1", "person_id": "p1", "credit_type": "guest", "billing_order": None},
        {"work_id": "w3", "person_id": "p1", "credit_type": "performer", "billing_order": 1},
    ],
}
