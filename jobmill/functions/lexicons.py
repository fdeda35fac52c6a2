"""Lexicons of the posting rules.

A lexicon is an ordered dict from tag to pattern. Patterns are searched with
Java's Unicode flags (see ``compiled``), so Cyrillic folds like Latin.
"""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rules:
    """What decides over a title: tags to look for, tags that reject, and two special cases."""

    domains: dict[str, str]
    contexts: dict[str, str]
    roles: dict[str, str]
    #: Rejects unless the tag beside it is among the domains: (tag given as blocked, pattern, domain that saves).
    unless: tuple[str, str, str] | None = None
    #: A title with this domain alone needs the pattern: (domain, pattern, reason).
    alone: tuple[str, str, str] | None = None
    reasons: dict[str, str] = field(default_factory=dict)


def compiled(pattern: str) -> str:
    return "(?iU)" + pattern


# Tags and patterns, in the order in which tags are reported.
DOMAINS = {
    "ml": r"(?:\bmachine\s+learning\b|(?<![a-z0-9])ml(?![a-z0-9])|\bml[-\s]?инженер\w*\b|машинн\w*\s+обуч\w*)",
    "ds": r"(?:\bdata\s+scient(?:ist|ists)?\b|\bdata\s+science\b|дата[-\s]?сайентист\w*)",
    "ai": r"(?:\bartificial\s+intelligence\b|(?<![a-z0-9])ai(?![a-z0-9])|(?<![а-яё])ии(?![а-яё])|искусственн\w*\s+интеллект\w*|\bgen(?:erative)?\s*ai\b|\bgenai\b)",
    "cv": r"(?:\bcomputer\s+vision\b|(?<![a-z0-9])cv(?![a-z0-9])|компьютерн\w*\s+зрен\w*)",
    "nlp": r"(?<![a-z0-9])nlp(?![a-z0-9])|обработк\w*\s+естественн\w*\s+язык\w*",
    "llm": r"(?<![a-z0-9])llm(?:s)?(?![a-z0-9])|large\s+language\s+model",
    "vlm": r"(?<![a-z0-9])vlm(?:s)?(?![a-z0-9])|vision[-\s]+language",
    "dl": r"(?:\bdeep\s+learning\b|(?<![a-z0-9])dl(?![a-z0-9])|глубок\w*\s+обуч\w*)",
    "mlops": r"(?:\bmlops\b|\bml\s+infrastructure\b|ml[-\s]platform)",
}
# Tags and patterns, in the order in which tags are reported.
ROLES = {
    "leadership": r"(?:\btech\s*lead\b|\bteam\s*lead(?:er)?\b|\bteamlead\b|(?<![a-z])\blead\b(?![a-z])|тимлид\w*|тим\s*лид\w*|\bhead\b|\bdirector\b|\bcto\b|директор\w*|руководител\w*|начальник\w*)",
    "product_project": r"(?:\bproduct\s+(?:manager|owner)\b|\bproject\s+manager\b|продакт[-\s]?менеджер\w*|проектн\w*\s+менеджер\w*|менеджер\s+продукт\w*|владелец\s+продукт\w*)",
    "system_business_analyst": r"(?:\bsystem\s+analyst\b|\bbusiness\s+analyst\b|системн\w*\s+аналитик\w*|бизнес[-\s]?аналитик\w*)",
    "ios": r"(?<![a-z0-9])ios(?![a-z0-9])|swift\s+developer",
    "android": r"(?<![a-z0-9])android(?![a-z0-9])|kotlin\s+developer",
    "mobile": r"\bmobile\s+(?:developer|engineer)\b|мобильн\w*\s+разработчик\w*",
    "frontend": r"\bfront[-\s]?end\b|\bfrontend\b|фронтенд\w*|frontender",
    "qa": r"(?<![a-z0-9])qa(?![a-z0-9])|тестировщик\w*|quality\s+assurance|контрол\w*\s+качеств\w*",
    "1c": r"(?<![a-zа-яё0-9])1[csс](?![a-zа-яё0-9])|\b1с[-\s]?разработчик",
    "csharp_dotnet": r"(?<![a-z0-9])c#(?![a-z0-9])|(?<![a-z0-9])\.net(?![a-z0-9])",
    "unity": r"(?<![a-z0-9])unity(?![a-z0-9])",
    "design": r"(?:ux\s*[/&+\-]?\s*ui|ui\s*[/&+\-]?\s*ux|(?<![a-z])ux(?![a-z])|(?<![a-z])ui(?![a-z])|designer|дизайнер\w*)",
    "web_site": r"(?:создан\w*\s+сайт\w*|разработк\w*\s+сайт\w*|\bweb\s+(?:developer|engineer)\b|веб[-\s]?разработчик\w*|website)",
    "content_ops": r"(?:управлен\w*\s+контент\w*|контент[-\s]?(?:менеджер|специалист)\w*|\bcontent\s+(?:manager|specialist)\b)",
}
# Tags and patterns, in the order in which tags are reported.
CONTEXTS = {
    "drones_uav": r"(?:\bбпла\b|беспилот\w*|дрон\w*|\bdrone\w*\b|(?<![a-z0-9])uav(?![a-z0-9])|(?<![a-z0-9])uas(?![a-z0-9])|(?<![a-z0-9])fpv(?![a-z0-9]))",
    "military_defence": r"(?:\bсво\b|военн\w*|вооруженн\w*\s+сил\w*|минобор\w*|оборонн\w*|оборонно[-\s]?промышлен\w*|гособоронзаказ\w*|\bгоз\b|\bmilitary\b|\bdefen[cs]e\b|армейск\w*|\bармия\b)",
    "war_region": r"(?:донецк\w*|\bднр\b|луганск\w*|\bлнр\b|мариупол\w*|херсон\w*|запорож\w*)",
    "relocation": r"(?:релокац\w*|\brelocat(?:e|ion|ing)?\b|переезд\w*|готовност\w*\s+к\s+переезд\w*|вахт\w*)",
}
# Two patterns.
DEVOPS = r"(?<![a-z0-9])devops(?![a-z0-9])"
ENGINEERING = r"(?:engineer|developer|researcher|scientist|architect|инженер\w*|разработчик\w*|исследовател\w*|архитектор\w*|сайентист\w*)"

POSTING_RULES = Rules(DOMAINS, CONTEXTS, ROLES, ("devops", DEVOPS, "mlops"), ("ai", ENGINEERING, "generic_ai_non_engineering_title"), {"unless": "devops_without_mlops"})

# Letter sentences and templates.
FOCUS = [
    (("llm", "vlm", "nlp"), "Особенно интересны задачи вокруг LLM/NLP/VLM и их production-интеграции."),
    (("cv",), "Особенно интересны задачи компьютерного зрения и доведение моделей до рабочего пайплайна."),
    (("mlops",), "Особенно интересна ML-инфраструктура: пайплайны, деплой и эксплуатация моделей."),
    (("ds",), "Интересны задачи анализа данных, моделирования и доведения решений до продукта."),
    (("ml", "dl", "ai"), "Интересны практические ML/AI-задачи и доведение решений до рабочего сервиса."),
]
FOCUS_OTHER = "Задачи вакансии близки моему текущему профессиональному направлению."
SKILLS_SHARED = "По стеку вижу прямое пересечение: %s."
SKILLS_TITLE = "Мой текущий профиль в резюме — «%s», поэтому направление мне близко."
SKILLS_OTHER = "Профиль вакансии совпадает с направлением, в котором я сейчас работаю и развиваюсь."
# Title, company phrase, then focus and skills (the third template has skills first).
TEMPLATES = {
    "t1": "Здравствуйте! Откликаюсь на вакансию «%s»%s. %s %s Буду рад обсудить задачи команды.",
    "t2": "Добрый день! Заинтересовала позиция «%s»%s. %s %s Готов подробнее рассказать о релевантном опыте.",
    "t3": "Здравствуйте! Хочу откликнуться на позицию «%s»%s. %s %s Буду рад познакомиться и обсудить, чем могу быть полезен команде.",
}
