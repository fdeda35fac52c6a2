"""Source postings to canonical rows: nested structs in, columns out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from jobmill.functions.text import optional_text, strip_tags, visible_text, zoned_time

MONEY = "decimal(38,9)"


def field(df: DataFrame, path: str, kind: str = "string") -> Column:
    """The nested field, or a null where the schema lacks it, so that postings of any age map."""
    schema = df.schema
    for part in path.split("."):
        if not isinstance(schema, StructType) or part not in schema.fieldNames():
            return F.lit(None).cast(kind)
        schema = schema[part].dataType
    return F.col(path)


def salary(df: DataFrame, p: str) -> Column:
    """struct(from, to, currency) of salary, else of salary_range, else nulls; exact decimals, overflow null."""
    def part(group: str, name: str) -> Column:
        c = field(df, f"{p}.{group}.{name}")
        return c if name == "currency" else c.try_cast(MONEY)

    first = field(df, f"{p}.salary.from").isNotNull() | field(df, f"{p}.salary.to").isNotNull() | field(df, f"{p}.salary.currency").isNotNull()
    return F.struct(*[F.when(first, part("salary", n)).otherwise(part("salary_range", n)).alias(n) for n in ("from", "to", "currency")])


def is_remote(df: DataFrame, p: str) -> Column:
    by_schedule = F.lower(field(df, f"{p}.schedule.id")) == "remote"
    formats = field(df, f"{p}.work_format", "array<struct<id:string>>")
    by_format = F.exists(formats, lambda f: F.coalesce(F.upper(f["id"]) == "REMOTE", F.lit(False)))
    return F.coalesce(by_schedule, F.lit(False)) | F.coalesce(by_format, F.lit(False))


def canonical_posting(df: DataFrame, payload: str, source: str = "board", provenance: list[str] = ()) -> DataFrame:
    """Canonical rows of full postings; ``valid`` is false without identifier, name or employer name."""
    p = payload
    money = salary(df, p)
    out = df.select(
        *provenance, F.lit(source).alias("source"), optional_text(field(df, f"{p}.id")).alias("source_entity_id"), optional_text(field(df, f"{p}.name")).alias("title"),
        optional_text(field(df, f"{p}.employer.name")).alias("company_name"), field(df, f"{p}.employer.id").cast("string").alias("company_id"),
        visible_text(field(df, f"{p}.description")).alias("description"), field(df, f"{p}.area.name").alias("area_name"), field(df, f"{p}.alternate_url").alias("url"),
        money["from"].alias("salary_from"), money["to"].alias("salary_to"), money["currency"].alias("salary_currency"), is_remote(df, p).alias("remote"),
        F.coalesce(optional_text(field(df, f"{p}.employment.id")), optional_text(field(df, f"{p}.employment_form.id"))).alias("employment_type"),
        field(df, f"{p}.experience.id").alias("experience"), zoned_time(field(df, f"{p}.published_at")).alias("published_at"),
    )
    return out.withColumn("valid", F.col("source_entity_id").isNotNull() & F.col("title").isNotNull() & F.col("company_name").isNotNull())


def operational_flags(df: DataFrame, p: str) -> Column:
    """struct of the board's flags; an absent flag is false."""
    def flag(name: str) -> Column:
        return F.coalesce(field(df, f"{p}.{name}").cast("boolean"), F.lit(False)).alias(name)

    relations = F.coalesce(field(df, f"{p}.relations", "array<string>"), F.array().cast("array<string>")).alias("relations")
    return F.struct(relations, flag("has_test"), optional_text(field(df, f"{p}.response_url")).alias("response_url"), flag("response_letter_required"), flag("archived"), flag("closed_for_applicants"))


def synced(postings: DataFrame, payload: str, source: str = "board", provenance: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(sound postings, rejected ones): of each its raw payload as JSON text, canonical columns and operational flags, in one row."""
    df = postings.withColumns({"flags": operational_flags(postings, payload), "raw": F.to_json(payload)})
    rows = canonical_posting(df, payload, source, [*provenance, "raw", "flags"])
    return rows.filter("valid").drop("valid"), rows.filter("not valid").select(*provenance, "source_entity_id", "raw")


def search_item(df: DataFrame, p: str, provenance: list[str] = ()) -> DataFrame:
    """Six fields of a search item; an employer or area that is no object is empty."""
    return df.select(
        *provenance, optional_text(field(df, f"{p}.id")).alias("source_entity_id"), optional_text(field(df, f"{p}.name")).alias("title"), optional_text(field(df, f"{p}.employer.name")).alias("company_name"),
        optional_text(field(df, f"{p}.area.name")).alias("area_name"), optional_text(field(df, f"{p}.alternate_url")).alias("url"), zoned_time(field(df, f"{p}.published_at")).alias("published_at"))


def mapped(df: DataFrame, spec: dict[str, tuple], payload: str = "") -> DataFrame:
    """Columns by ``name: (dotted path, type, default[, transform])``; ``uncast`` keeps the values that don't cast, as text by column (null or the default stand in the column), ``cast_failures`` counts them."""
    out, failures, uncast = [], F.lit(0), []
    for name, (path, kind, default, *more) in spec.items():
        raw = field(df, f"{payload}.{path}" if payload else path)
        raw = more[0](raw) if more else raw
        is_nested = kind == "json"
        value = F.to_json(raw) if is_nested else raw.try_cast(kind)
        failed = raw.isNotNull() & value.isNull()
        failures = failures + failed.cast("int")
        uncast.append(F.when(failed, F.struct(F.lit(name).alias("key"), (F.to_json(raw) if isinstance(df.select(raw.alias("x")).schema[0].dataType, ArrayType | MapType | StructType) else raw.cast("string")).alias("value"))))
        out.append(F.coalesce(value, F.lit(default)).alias(name) if default is not None else value.alias(name))
    kept = F.filter(F.array(*uncast), lambda x: x.isNotNull()) if uncast else F.array().cast("array<struct<key:string,value:string>>")
    return df.select(*out, failures.alias("cast_failures"), F.map_from_entries(kept).alias("uncast"))


def posting_row(df: DataFrame, p: str) -> DataFrame:
    """Salary filled both ways, currency RUR by default, remote flag, roles as JSON."""
    lo, hi = (F.nullif(field(df, f"{p}.salary.{n}").try_cast("long"), F.lit(0)) for n in ("from", "to"))
    zero = F.lit(0).cast("long")
    roles = field(df, f"{p}.professional_roles", "array<struct<id:string>>")
    return df.select(
        field(df, f"{p}.id").alias("id"), field(df, f"{p}.name").alias("name"), F.coalesce(lo, hi, zero).alias("salary_from"), F.coalesce(hi, lo, zero).alias("salary_to"),
        F.coalesce(field(df, f"{p}.salary.currency"), F.lit("RUR")).alias("currency"), is_remote(df, p).alias("remote"), F.to_json(roles).alias("professional_roles"))


def phones(c: Column) -> Column:
    """Formatted numbers of those that have one, comma between."""
    return F.array_join(F.transform(F.filter(c, lambda x: x["number"].isNotNull()), lambda x: x["formatted"]), ", ")


def resume_title(title: Column, name: Column) -> Column:
    return optional_text(F.coalesce(title, name))


def upstream_status(status_json: Column) -> Column:
    """Status given as text or as an object with an id."""
    return F.coalesce(F.get_json_object(status_json, "$.id"), F.when(~status_json.startswith("{"), F.regexp_replace(status_json, '^"|"$', "")))


def keep_keys(json_map: Column, keys: list[str]) -> Column:
    """The listed keys of a JSON object, as text map."""
    return F.map_filter(F.from_json(json_map, "map<string,string>"), lambda k, v: k.isin(*keys) & v.isNotNull())


def evidence_metadata(relations: Column, **parts: Column) -> Column:
    """JSON of relations and those parts that aren't null."""
    return F.to_json(F.struct(relations.alias("relations"), *[c.alias(n) for n, c in parts.items()]))


def effective(value: Column, default: Column) -> Column:
    """A query's own parameter, unless absent or 0."""
    return F.coalesce(F.nullif(value, F.lit(0)), default)


def posting_context(title: Column, description: Column, skills: Column) -> Column:
    """Title and description without tags, or title and skills."""
    return F.concat_ws("\n", title, F.coalesce(optional_text(strip_tags(description)), F.array_join(skills, ", ")))


def resume_context(title: Column, skills: Column, experience: Column) -> Column:
    """Title, skills, and company and position of each experience entry."""
    past = F.array_join(F.transform(experience, lambda x: F.concat_ws(": ", x["company"], x["position"])), "\n")
    return F.concat_ws("\n", title, F.array_join(skills, ", "), past)


def flatten_children(df: DataFrame, key: list[str], children: str) -> DataFrame:
    """Categories and their entries as parent-child rows."""
    return df.select(*[F.col(k).alias(f"parent_{k}") for k in key], F.explode(children).alias("c")).select(*[f"parent_{k}" for k in key], "c.*")


def submission_mode(has_test: Column) -> Column:
    return F.when(F.coalesce(has_test, F.lit(False)), "upstream_hh_test").otherwise("negotiations_api")


def reconcile_audit(changes: DataFrame, account: list[str], resume: str, change: str, fields: list[str]) -> DataFrame:
    """One row per account: identifiers of each kind of change in order, and a list of its résumés with ``fields``, never their text."""
    kinds = {"registered_ids": "registered", "updated_ids": "updated", "reactivated_ids": "reactivated", "deleted_ids": "deleted"}
    lists = [F.array_sort(F.collect_list(F.when(F.col(change) == kind, F.col(resume)))).alias(name) for name, kind in kinds.items()]
    return changes.groupBy(*account).agg(*lists, F.array_sort(F.collect_list(F.struct(resume, *fields))).alias("resumes"))


def without_nulls(df: DataFrame, c: str) -> Column:
    """JSON of a nested column, at any depth without null array entries and null map values; ``to_json`` leaves null fields out."""
    def clean(col: Column, kind: DataType) -> Column:
        if isinstance(kind, ArrayType):
            return F.transform(F.filter(col, lambda x: x.isNotNull()), lambda x: clean(x, kind.elementType))
        if isinstance(kind, MapType):
            return F.transform_values(F.map_filter(col, lambda _, v: v.isNotNull()), lambda _, v: clean(v, kind.valueType))
        if isinstance(kind, StructType):
            return F.when(col.isNotNull(), F.struct(*[clean(col[f.name], f.dataType).alias(f.name) for f in kind]))
        return col

    return F.to_json(clean(F.col(c), df.schema[c].dataType))
