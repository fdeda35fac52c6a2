"""Column expressions over text, HTML, times and JSON."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobmill.functions import lexicons as L


def optional_text(c: Column) -> Column:
    """Trimmed text; null when nothing is left."""
    t = F.trim(c.cast("string"))
    return F.when(t != "", t)


def visible_text(html: Column) -> Column:
    """Text between tags: fragments trimmed, empty ones dropped, one a line, common entities decoded."""
    parts = F.transform(F.split(html, "<[^>]*>"), lambda x: F.trim(F.regexp_replace(x, r"^[\s]+|[\s]+$", "")))
    return decode_entities(F.array_join(F.filter(parts, lambda x: x != ""), "\n"))


def decode_entities(c: Column) -> Column:
    for name, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def break_to_newline(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(break_to_newline(c), r"<[^>]*>", ""))


def zoned_time(c: Column) -> Column:
    """ISO time with an offset (+0300, +03:00, Z) as a UTC timestamp; null without an offset."""
    return F.when(c.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))


def api_time(c: Column, fmt: str = "yyyy-MM-dd'T'HH:mm:ssZ") -> Column:
    return F.coalesce(F.try_to_timestamp(c, F.lit(fmt)), F.try_to_timestamp(c))


def api_time_text(c: Column, shown: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    """The time in one form, in the session's zone; what is no time stays as it is."""
    return F.coalesce(F.date_format(api_time(c), shown), c)


def skill_form(c: Column) -> Column:
    """Lower case letters, digits and + # . only."""
    return F.regexp_replace(F.lower(c), "[^a-zа-яё0-9+#.]+", "")


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def pick(seed: Column, n: int) -> Column:
    """A choice below n from the first byte of the seed's digest."""
    return F.conv(F.substring(sha256(seed), 1, 2), 16, 10).cast("int") % n


def focus(domains: Column) -> Column:
    out = None
    for tags, sentence in L.FOCUS:
        hit = F.arrays_overlap(domains, F.array(*map(F.lit, tags)))
        out = F.when(hit, sentence) if out is None else out.when(hit, sentence)
    return out.otherwise(L.FOCUS_OTHER)


def letter(title: Column, company: Column, domains: Column, skills: Column, resume_title: Column, seed: Column) -> Column:
    """struct(template_id, message): the seed chooses one of three templates."""
    phrase = F.when(optional_text(company).isNotNull(), F.concat(F.lit(" в "), F.trim(company))).otherwise("")
    shared = F.when(F.size(skills) > 0, F.format_string(L.SKILLS_SHARED, F.array_join(skills, ", ")))
    own = F.when(optional_text(resume_title).isNotNull(), F.format_string(L.SKILLS_TITLE, F.trim(resume_title)))
    said = F.coalesce(shared, own, F.lit(L.SKILLS_OTHER))
    name = F.trim(F.coalesce(F.when(title != "", title), F.lit("вакансию")))
    n, f = pick(seed, len(L.TEMPLATES)), focus(domains)
    texts = [F.format_string(t, name, phrase, *((said, f) if k == "t3" else (f, said))) for k, t in L.TEMPLATES.items()]
    made = F.array(*[F.struct(F.lit(k).alias("template_id"), t.alias("message")) for k, t in zip(L.TEMPLATES, texts, strict=True)])
    return F.element_at(made, n + 1)


def choice_text(c: Column, seed: Column) -> Column:
    """``{a|b}`` replaced by one alternative, innermost first, at any depth; braces that aren't a pair, or hold nothing, stay.

    One pass over braces and what is between them, with a stack of open groups.
    The choice is hashed from the seed and the group's text, so it is the same in every run.
    """
    # each open group: its text so far, and whether a brace stays within it
    group = "struct<t:string,kept:boolean>"

    def made(t: Column, kept: Column) -> Column:
        return F.struct(t.alias("t"), kept.alias("kept"))

    def step(stack: Column, token: Column) -> Column:
        top, rest = F.element_at(stack, -1), F.slice(stack, 1, F.size(stack) - 1)
        options = F.split(top["t"], r"\|")
        chosen = F.element_at(options, F.pmod(F.xxhash64(seed, top["t"]), F.size(options).cast("long")).cast("int") + 1)
        under = F.element_at(rest, -1)
        whole = ~top["kept"] & (top["t"] != "")
        closed = F.concat(F.slice(rest, 1, F.size(rest) - 1), F.array(F.when(whole, made(F.concat(under["t"], chosen), under["kept"])).otherwise(made(F.concat(under["t"], F.lit("{"), top["t"], F.lit("}")), F.lit(True)))))
        longer = F.concat(rest, F.array(made(F.concat(top["t"], token), top["kept"])))
        pushed = F.concat(stack, F.array(made(F.lit(""), F.lit(False))))
        return F.when(token == "{", pushed).when((token == "}") & (F.size(stack) > 1), closed).otherwise(longer).cast(f"array<{group}>")

    start = F.array(made(F.lit(""), F.lit(False))).cast(f"array<{group}>")
    tokens = F.regexp_extract_all(c, F.lit(r"([{}]|[^{}]+)"), F.lit(1))
    return F.aggregate(tokens, start, step, lambda stack: F.array_join(F.transform(stack, lambda x: x["t"]), "{"))


def first_of_key(json: Column, key: str) -> Column:
    """The first value of a key at any depth of a JSON text, depth first, that isn't null; text without quotes, else JSON. Null where there is none or the text is no JSON.

    An object that has the key answers for all that is below it. A key that an
    object repeats has its last value. One pass over the text's tokens with a
    stack of open objects and lists; only places of the key are kept.
    """
    text = F.regexp_extract_all(json, F.lit(r'("(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]+)'), F.lit(1))
    place = "struct<at:int,first:int,last:int>"  # token after the colon; first and last token of the object
    state = f"struct<i:int,stack:array<int>,found:array<{place}>>"

    def named(t: Column) -> Column:
        plain = F.when(t.contains("\\"), F.get_json_object(F.concat(F.lit('{"x":'), t, F.lit("}")), "$.x")).otherwise(F.substring(t, F.lit(2), F.length(t) - 2))
        return t.startswith('"') & (plain == key)

    def step(s: Column, t: Column, tokens: Column) -> Column:
        i, top = s["i"] + 1, F.element_at(s["stack"], -1)
        closed = F.transform(s["found"], lambda f: F.struct(f["at"].alias("at"), f["first"].alias("first"), F.when(f["first"] == top, i).otherwise(f["last"]).alias("last")))
        here = (F.get(tokens, i) == ":") & named(t)
        # the same object again: its last value stays
        again = F.filter(s["found"], lambda f: f["first"] != top)
        found = F.when(here, F.concat(again, F.array(F.struct((i + 2).alias("at"), top.alias("first"), F.lit(None).cast("int").alias("last"))))).when(t == "}", closed).otherwise(s["found"])
        stack = F.when(t.isin("{", "["), F.concat(s["stack"], F.array(i))).when(t.isin("}", "]"), F.slice(s["stack"], 1, F.size(s["stack"]) - 1)).otherwise(s["stack"])
        return F.struct(i.alias("i"), stack.alias("stack"), found.alias("found")).cast(state)

    def value(tokens: Column, at: Column) -> Column:
        """JSON text of the value that begins with the token at the place (from 1)."""
        deep = "struct<n:int,depth:int,done:boolean>"
        after = F.slice(tokens, at, F.size(tokens))

        def walk(s: Column, t: Column) -> Column:
            d = s["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
            return F.when(s["done"], s).otherwise(F.struct((s["n"] + 1).alias("n"), d.alias("depth"), (d == 0).alias("done")).cast(deep))

        end = F.aggregate(after, F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("done")).cast(deep), walk)
        return F.array_join(F.slice(after, 1, end["n"]), "")

    def pick(tokens: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("stack"), F.array().cast(f"array<{place}>").alias("found")).cast(state)
        found = F.aggregate(tokens, start, lambda s, t: step(s, t, tokens))["found"]
        highest = F.filter(found, lambda f: ~F.exists(found, lambda g: (g["first"] < f["first"]) & (f["last"] < g["last"])))
        return F.filter(F.transform(F.array_sort(F.transform(highest, lambda f: F.struct(f["first"].alias("a"), f["at"].alias("b")))), lambda f: value(tokens, f["b"])), lambda v: v != "null")

    first = F.get(F.transform(F.array(text), pick), F.lit(0))
    return F.when(F.get_json_object(json, "$").isNotNull(), F.get_json_object(F.concat(F.lit('{"x":'), F.get(first, F.lit(0)), F.lit("}")), "$.x"))


def shorten(c: Column, limit: int = 75, mark: str = "…") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - len(mark)), F.lit(mark))).otherwise(c)


def unescape(c: Column) -> Column:
    r"""``\n \r \t \\`` as the characters they stand for."""
    hold = "\x00"
    c = F.replace(c, F.lit("\\\\"), F.lit(hold))
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), (hold, "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def list_text(c: Column) -> Column:
    return F.array_join(c, ", ")


def flag_text(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def with_scheme(url: Column, scheme: str = "https") -> Column:
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit(f"{scheme}://"), url))


#: Fixed value: a mail address in landed HTML, asset names such as icon@2x.png aside.
MAIL = r"\b[a-z][a-z0-9_.-]+@[a-z0-9][a-z0-9-]+(?!\.(?:png|jpe?g|bmp|gif|ico|js|css)\b)(?:\.[a-z0-9][a-z0-9-]+)+\b"


def page_facts(html: Column) -> Column:
    """struct(title, description, generator, emails) of a landed page; what is absent is empty."""
    def first(p: str) -> Column:
        return decode_entities(F.regexp_extract(html, p, 1))

    # Patterns of the page.
    return F.struct(
        first(r"(?is)<title>(.*?)</title>").alias("title"),
        first(r'(?i)<meta name="description" content="(.*?)"').alias("description"),
        first(r'(?i)<meta name="generator" content="(.*?)"').alias("generator"),
        F.array_distinct(F.regexp_extract_all(html, F.lit(MAIL), F.lit(0))).alias("emails"),
    )


def verdict(answer: Column) -> Column:
    """True, false or null from a free answer: a bare word, or ``"suitable"`` in embedded JSON."""
    t = F.lower(F.trim(answer))
    found = F.regexp_extract(t, r'\{[^{}]*"suitable"\s*:\s*(true|false)[^{}]*\}', 1)
    return F.when(t.isin("да", "yes", "true"), True).when(t.isin("нет", "no", "false"), False).when(found == "true", True).when(found == "false", False)


def first_of_paths(json: Column, paths: list[str]) -> Column:
    """The first of the JSON paths that holds a value."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def redact(c: Column, least: int = 32) -> Column:
    """Long hexadecimal tokens (and upper-case ones of twice the length) masked by as many asterisks."""
    # Fixed value: the form of a token.
    token = rf"\b[A-Z0-9]{{{2 * least},}}\b|\b[a-fA-F0-9]{{{least},}}\b"
    found = F.regexp_extract_all(c, F.lit(f"({token})"), F.lit(1))
    rest = F.split(c, token)
    masked = F.transform(rest, lambda x, i: F.concat(x, F.coalesce(F.repeat(F.lit("*"), F.length(F.get(found, i))), F.lit(""))))
    return F.array_join(masked, "")


def month_date(c: Column) -> Column:
    """``MM.YYYY`` as the first of that month, YYYY-MM-01."""
    m = F.regexp_extract(c, r"^\s*(\d{1,2})\.(\d{4})\s*$", 1)
    y = F.regexp_extract(c, r"^\s*(\d{1,2})\.(\d{4})\s*$", 2)
    return F.when(y != "", F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-01")))


def phone_parts(c: Column) -> Column:
    """struct(country, city, number) of the digits; +7 and 8 are the same country."""
    d = F.regexp_replace(c, r"\D", "")
    d = F.when((F.length(d) == 11) & d.startswith("8"), F.concat(F.lit("7"), F.substring(d, 2, 10))).otherwise(d)
    return F.when(F.length(d) == 11, F.struct(F.substring(d, 1, 1).alias("country"), F.substring(d, 2, 3).alias("city"), F.substring(d, 5, 7).alias("number")))


def amount(c: Column, currencies: dict[str, str]) -> Column:
    """struct(amount, currency): the first number, spaces inside allowed, and the code of the first mark found."""
    n = F.regexp_replace(F.regexp_extract(c, r"(\d[\d\s]*)", 1), r"\s", "").try_cast("long")
    code = F.coalesce(*[F.when(F.contains(F.lower(c), F.lit(mark)), code) for mark, code in currencies.items()])
    return F.when(n.isNotNull(), F.struct(n.alias("amount"), code.alias("currency")))


def has_captcha(error: Column) -> Column:
    return F.contains(F.lower(error), F.lit("captcha"))


def tags(text: Column, lexicon: dict[str, str]) -> Column:
    """Tags whose pattern occurs in the text, in the lexicon's order."""
    hits = F.array(*[F.when(text.rlike(L.compiled(p)), tag) for tag, p in lexicon.items()])
    return F.filter(hits, lambda x: x.isNotNull())


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
