"""Decisions over posting titles and texts."""

import pytest
from pyspark.sql import functions as F

from jobmill.functions import text as T
from jobmill.operators import rules

# title, description, response_url -> accepted, reason or None, a blocked term or None; one title or more for each branch of the cascade
CASES = [
    ("ml engineer (ranking)", "", None, True, "accepted", None), ("Data scientists wanted", "", None, True, None, None), ("Инженер машинного обучения, антифрод", "", None, True, None, None), ("Исследователь (обработка естественного языка)", "", None, True, None, None),
    ("VLM researcher", "", None, True, None, None), ("Deep learning developer, speech", "", None, True, None, None), ("Разработчик компьютерного зрения в логистике", "", None, True, None, None), ("GenAI developer", "", None, True, None, None),
    ("MLOps / DevOps developer", "", None, True, None, None), ("Архитектор ИИ", "", None, True, None, None), ("NLP", "", None, True, None, None),
    ("Head of Data Science", "", None, False, "title_contains_unrelated_role", "leadership"), ("Руководитель группы NLP", "", None, False, None, "leadership"), ("Project manager, deep learning", "", None, False, None, "product_project"),
    ("Владелец продукта LLM", "", None, False, None, "product_project"), ("Бизнес-аналитик (ML)", "", None, False, None, "system_business_analyst"), ("Android developer, on-device ML", "", None, False, None, "android"),
    ("Kotlin developer (CV)", "", None, False, None, "android"), ("Swift developer, vision-language apps", "", None, False, None, "ios"), ("Mobile engineer for NLP", "", None, False, None, "mobile"), ("Фронтендер для LLM-чата", "", None, False, None, "frontend"),
    ("Тестировщик моделей машинного обучения", "", None, False, None, "qa"), ("1C и машинное обучение", "", None, False, None, "1c"), ("Researcher, ML on .NET", "", None, False, None, "csharp_dotnet"), ("Unity developer with computer vision", "", None, False, None, "unity"),
    ("Дизайнер диалогов LLM", "", None, False, None, "design"), ("Веб-разработчик, GenAI", "", None, False, None, "web_site"), ("Контент-менеджер (ИИ)", "", None, False, None, "content_ops"),
    ("DevOps for deep learning", "", None, False, "devops_without_mlops", "devops"), ("Artificial intelligence evangelist", "", None, False, "generic_ai_non_engineering_title", None), ("Куратор курса по ИИ", "", None, False, "generic_ai_non_engineering_title", None),
    ("Deep learning for drone racing", "", None, False, "excluded_context", "drones_uav"), ("Data scientist (military analytics)", "", None, False, "excluded_context", "military_defence"), ("NLP, Херсон", "", None, False, "excluded_context", "war_region"),
    ("NLP researcher", "Our customer is the ministry of defence", None, False, "excluded_context", "military_defence"), ("Data scientist", "Помогаем с переездом", None, False, "excluded_context", "relocation"), ("LLM developer", "Офис в Луганске", None, False, None, "war_region"),
    ("VLM engineer", "Simulators of uav flight", None, False, None, "drones_uav"), ("NLP developer", "", "https://jobs.example/42", False, "external_response_url", None), ("   ", "", None, False, "missing_title", None), ("Водитель погрузчика", "", None, False, "title_out_of_scope", None),
    ("Html mail developer", "", None, False, "title_out_of_scope", None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0], c[1], c[2]) for i, c in enumerate(CASES)], "i int, title string, description string, url string")
    no = F.lit(False)
    out = rules.full_gate(df, "title", rules.full_context(F.col("title"), F.col("description")), no, no, F.col("url"), rules.area_id(F.lit("1")))
    got = {r["i"]: r["decision"] for r in out.collect()}
    for i, (title, _, _, accepted, reason, blocked) in enumerate(CASES):
        assert got[i]["accepted"] is accepted, title
        assert reason is None or got[i]["reason"] == reason, title
        assert blocked is None or blocked in got[i]["blocked_terms"], title


@pytest.mark.parametrize("archived, closed, url, area, reason", [
    (True, True, "u", "2", "archived"), (False, True, "u", "2", "closed_for_applicants"), (False, False, "u", "2", "external_response_url"),
    (False, False, None, "2", "area_2_not_allowed"), (False, False, "", "x", "accepted"), (None, None, None, None, "accepted"),
])
def test_gate_order(spark, archived, closed, url, area, reason):
    df = spark.createDataFrame([("ML Engineer", archived, closed, url, area)], "t string, a boolean, c boolean, u string, r string")
    out = rules.full_gate(df, "t", F.lit(""), F.col("a"), F.col("c"), F.col("u"), rules.area_id(F.col("r")))
    assert out.first()["decision"]["reason"] == reason


def test_search_gate_and_log(spark):
    df = spark.createDataFrame([(1, "ML Engineer", False), (2, "ML Engineer", True), (3, "Cook", False), (4, None, None)], "id int, t string, a boolean")
    gate = rules.search_gate(df, "t", F.col("a"), out="searched")
    assert {r["id"]: r["searched"]["reason"] for r in gate.collect()} == {1: "accepted", 2: "archived", 3: "title_out_of_scope", 4: "missing_title"}
    log = rules.two_stage_log(rules.search_gate(gate, "t", F.col("a")), ["id"])
    assert {(r["id"], r["stage"], r["reason"]) for r in log.collect()} == {(1, "full_validation", "accepted"), (2, "prefilter", "prefilter_archived"), (3, "prefilter", "prefilter_title_out_of_scope"), (4, "prefilter", "prefilter_missing_title")}


def test_eligibility(spark):
    df = spark.createDataFrame([(["got_rejection"], False, False, None), ([], False, True, None), (None, None, None, "u")], "r array<string>, a boolean, t boolean, u string")
    got = df.select(rules.apply_eligibility(F.col("r"), F.col("a"), F.col("t"), F.col("u"), True).alias("e")).collect()
    assert [(r["e"]["eligible"], r["e"]["reason"], r["e"]["rejected"]) for r in got] == [(False, "relations", True), (False, "has_test", False), (False, "redirect", False)]


def test_text_functions(spark):
    df = spark.createDataFrame([(
        "<p>Hi &amp; <b> bye </b></p><br/>x", "2024-01-01T10:00:00+0300", "2024-01-01T10:00:00", "a{b|c}d", "x" * 80, r"a\nb\\n", "id=" + "ab" * 16 + ".", "8 (912) 345-67-89", "05.2020", "100 000 руб.", '```json\n{"suitable": true}\n```',
    )], "html string, z string, n string, c string, l string, e string, r string, p string, m string, s string, v string")
    r = df.select(
        T.visible_text(F.col("html")).alias("html"), T.zoned_time(F.col("z")).alias("z"), T.zoned_time(F.col("n")).alias("n"), T.choice_text(F.col("c"), F.lit("s")).alias("c"), T.shorten(F.col("l")).alias("l"),
        T.unescape(F.col("e")).alias("e"), T.redact(F.col("r")).alias("r"), T.phone_parts(F.col("p")).alias("p"), T.month_date(F.col("m")).alias("m"), T.amount(F.col("s"), {"руб": "RUR"}).alias("s"), T.verdict(F.col("v")).alias("v"),
    ).first()
    assert r["html"] == "Hi &\nbye\nx" and str(r["z"]) == "2024-01-01 07:00:00" and r["n"] is None
    assert r["c"] in ("abd", "acd") and len(r["l"]) == 75 and r["e"] == "a\nb\\n" and r["r"] == "id=" + "*" * 32 + "."
    assert tuple(r["p"]) == ("7", "912", "3456789") and r["m"] == "2020-05-01" and tuple(r["s"]) == (100000, "RUR") and r["v"] is True
