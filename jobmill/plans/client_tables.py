"""Field lists of the client's tables, for ``mapping.mapped``: column to (path, type, default[, transform])."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill.functions.text import zoned_time
from jobmill.operators.mapping import mapped, phones


def _joined(c: Column) -> Column:
    return F.array_join(c, ",")


# Paths, columns and defaults of the client's tables.
EMPLOYER = {
    "id": ("id", "long", None), "name": ("name", "string", None), "type": ("type", "string", None), "description": ("description", "string", None), "site_url": ("site_url", "string", None),
    "alternate_url": ("alternate_url", "string", None), "area_id": ("area.id", "long", None), "area_name": ("area.name", "string", None),
}
EMPLOYER_SITE = {
    "employer_id": ("employer_id", "long", None), "site_url": ("site_url", "string", None), "ip_address": ("ip_address", "string", None), "title": ("title", "string", None), "description": ("description", "string", None),
    "generator": ("generator", "string", None), "server_name": ("server_name", "string", None), "powered_by": ("powered_by", "string", None), "emails": ("emails", "string", "", _joined), "subdomains": ("subdomains", "string", "", _joined),
}
NEGOTIATION = {
    "id": ("id", "long", None), "chat_id": ("chat_id", "long", None), "state": ("state.id", "string", None), "vacancy_id": ("vacancy.id", "long", None), "employer_id": ("vacancy.employer.id", "long", None),
    "resume_id": ("resume.id", "string", None), "created_at": ("created_at", "timestamp", None, zoned_time), "updated_at": ("updated_at", "timestamp", None, zoned_time),
}
RESUME = {
    "id": ("id", "string", None), "title": ("title", "string", None), "url": ("url", "string", None), "alternate_url": ("alternate_url", "string", None), "status_id": ("status.id", "string", None), "status_name": ("status.name", "string", None),
    "can_publish_or_update": ("can_publish_or_update", "boolean", False), "total_views": ("counters.total_views", "int", 0), "new_views": ("counters.new_views", "int", 0),
    "created_at": ("created_at", "timestamp", None, zoned_time), "updated_at": ("updated_at", "timestamp", None, zoned_time),
}
CONTACT = {
    "vacancy_id": ("id", "long", None), "vacancy_name": ("name", "string", None), "vacancy_alternate_url": ("alternate_url", "string", None), "vacancy_area_id": ("area.id", "long", None), "vacancy_area_name": ("area.name", "string", None),
    "vacancy_salary_from": ("salary.from", "long", 0), "vacancy_salary_to": ("salary.to", "long", 0), "vacancy_currency": ("salary.currency", "string", "RUR"), "vacancy_gross": ("salary.gross", "boolean", False),
    "employer_id": ("employer.id", "long", None), "employer_name": ("employer.name", "string", None), "email": ("contacts.email", "string", None), "name": ("contacts.name", "string", None), "phone_numbers": ("contacts.phones", "string", None, phones),
}

# Labels of résumé fields and their codes.
CODES = {
    "gender": {"мужской": "male", "женский": "female"},
    "employment": {"полная занятость": "full", "полный рабочий день": "full", "частичная занятость": "part", "неполная занятость": "part", "проектная работа": "project", "волонтёрство": "volunteer", "волонтерство": "volunteer", "стажировка": "probation"},
    "schedule": {"полный день": "fullDay", "сменный график": "shift", "гибкий график": "flexible", "гибкий": "flexible", "удалённая работа": "remote", "удаленная работа": "remote", "удалённо": "remote", "вахта": "flyInFlyOut"},
    "relocation": {"не готов": "no_relocation", "невозможен": "no_relocation", "нет": "no_relocation", "готов": "relocation_possible", "возможен": "relocation_possible", "возможно": "relocation_possible", "желательно": "relocation_desirable", "желателен": "relocation_desirable"},
    "business_trip": {"никогда": "never", "нет": "never", "готов": "ready", "да": "ready", "иногда": "sometimes"},
    "travel_time": {"любое": "any", "не важно": "any", "до часа": "less_than_hour", "менее часа": "less_than_hour", "от часа до полутора": "from_hour_to_one_and_half"},
    "education": {
        "среднее": "secondary", "среднее специальное": "special_secondary", "неоконченное высшее": "unfinished_higher", "высшее": "higher", "бакалавр": "bachelor", "бакалавриат": "bachelor", "магистр": "master", "магистратура": "master",
        "кандидат наук": "candidate", "доктор наук": "doctor", "аспирантура": "post_graduate_study"},
    "language_level": {
        "a1": "a1", "a2": "a2", "b1": "b1", "b2": "b2", "c1": "c1", "c2": "c2", "l1": "l1", "родной": "l1", "начальный": "a1", "элементарный": "a1", "базовый": "a2", "средний": "b1", "выше среднего": "b2", "продвинутый": "c1",
        "свободный": "c2", "свободное владение": "c2"},
    "language": {
        "русский": "rus", "английский": "eng", "немецкий": "deu", "французский": "fra", "испанский": "spa", "итальянский": "ita", "португальский": "por", "китайский": "zho", "японский": "jpn", "корейский": "kor", "арабский": "ara",
        "турецкий": "tur", "польский": "pol", "украинский": "ukr", "белорусский": "bel", "казахский": "kaz"},
    "currency": {"руб": "RUR", "руб.": "RUR", "рублей": "RUR", "rub": "RUR", "rur": "RUR", "₽": "RUR", "usd": "USD", "долларов": "USD", "$": "USD", "eur": "EUR", "евро": "EUR", "€": "EUR"},
    "site": {"github": "github", "gitlab": "gitlab", "linkedin": "linkedin", "личный сайт": "personal", "личный": "personal", "портфолио": "portfolio", "живой журнал": "livejournal", "мой круг": "moi_krug"},
    "contact": {
        "email": "email", "e-mail": "email", "почта": "email", "электронная почта": "email", "мобильный": "cell", "мобильный телефон": "cell", "сотовый": "cell", "телефон": "cell", "домашний": "home", "домашний телефон": "home", "рабочий": "work", "рабочий телефон": "work"},
}


def contact_rows(df: DataFrame, payload: str) -> DataFrame:
    """Contacts of postings, salary filled both ways; postings without contacts give none."""
    c = mapped(df, CONTACT, payload).filter(F.col("email").isNotNull() | F.col("name").isNotNull() | F.col("phone_numbers").isNotNull())
    lo, hi = F.nullif("vacancy_salary_from", F.lit(0)), F.nullif("vacancy_salary_to", F.lit(0))
    zero = F.lit(0).cast("long")
    return c.withColumns({"vacancy_salary_from": F.coalesce(lo, hi, zero), "vacancy_salary_to": F.coalesce(hi, lo, zero)})


def coded(label: Column, kind: str) -> Column:
    """The code of a label, whatever its case and outer spaces; null if unknown."""
    pairs = [F.lit(x) for kv in CODES[kind].items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(label)))
