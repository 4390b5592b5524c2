"""Search intents: validate requests and turn them into a filter table.

A filter table has one row per filter: ``ord`` (its place, which decides ties),
``category`` and ``anchors`` (example sentences).  The sentences come from
templates or from a table of answers; a text generator is not part of this engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import let
from ..functions.text import (
    defaulted,
    fallback_category,
    is_blank,
    repeat_anchor,
    strip,
    trim_and_compact,
)

ANCHORS_PER_QUERY = 5

# Field names of a request and the messages for missing input.
FIELD_MESSAGES = {
    "desiredOutcome": "Input Error: Please enter a desired outcome.",
    "importantDate": "Input Error: Please enter an important date.",
    "importantPeople": "Input Error: Please enter important people.",
    "importantEvents": "Input Error: Please enter important events.",
    "importantLocation": "Input Error: Please enter an important location.",
}
FILE_MESSAGE = "Input Error: Please select a .zip file to upload."
DESCRIPTION_MESSAGE = "Input Error: Please enter a natural language description."
# Defaults for what a request or an answer leaves out.
DEFAULT_FIELD = "N/A"
DEFAULT_CATEGORY = "general_query"
DEFAULT_FIELDS_CATEGORY = "structured_query"

FIELDS = tuple(FIELD_MESSAGES)

# Example sentences for structured requests; one placeholder per field name.
FIELD_TEMPLATES = (
    "{importantPeople} was at {importantEvents} in {importantLocation} and it ended in {desiredOutcome}",
    "on {importantDate} there was a {desiredOutcome} in {importantLocation}",
    "did you hear what {importantPeople} did on {importantDate}",
    "{importantEvents} on {importantDate} had to do with {desiredOutcome}",
    "I met {importantPeople} in {importantLocation} during {importantEvents}",
)


def defaulted_fields(requests: DataFrame, default: str = DEFAULT_FIELD) -> DataFrame:
    """Every field of a request present; missing ones get the default."""
    filled = [defaulted(F.col(f"fields.{name}"), default).alias(name) for name in FIELDS]
    return requests.withColumn("fields", F.struct(*filled))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``errors`` (array), ``message`` (each error followed by ", ") and ``valid``.

    A file is always needed; a natural-language request needs its description,
    any other request needs all five fields.
    """
    nl = defaulted(F.col("usedNaturalLanguage"), False)
    checks = [F.when(is_blank(F.col("fileName")), F.lit(FILE_MESSAGE))]
    checks += [
        F.when(~nl & is_blank(F.col(f"fields.{name}")), F.lit(message))
        for name, message in FIELD_MESSAGES.items()
    ]
    checks.append(F.when(nl & is_blank(F.col("naturalLanguageDescription")), F.lit(DESCRIPTION_MESSAGE)))
    errors = F.filter(F.array(*checks), lambda e: e.isNotNull())
    checked = requests.withColumn("errors", errors)
    message = F.array_join(F.transform("errors", lambda e: F.concat(e, F.lit(", "))), "")
    return checked.withColumn("message", message).withColumn("valid", F.size("errors") == 0)


def split_description(requests: DataFrame, separators: str | None = None) -> DataFrame:
    """Sub-queries of a description as (.., sub, query).

    By default the whole text is one query; ``separators`` is a regular expression
    to split on, blank parts are dropped.
    """
    text = defaulted(F.col("naturalLanguageDescription"), "")
    if separators is None:
        parts = F.array(text)
    else:
        trimmed = F.transform(F.split(text, separators), lambda part: strip(part))
        parts = F.filter(trimmed, lambda part: part != "")
    keep = [c for c in requests.columns if c not in ("sub", "query")]
    return requests.select(*keep, F.posexplode(parts).alias("sub", "query"))


def _template_array(templates: DataFrame | Sequence[str]) -> Column:
    if isinstance(templates, DataFrame):
        ordered = F.array_sort(F.collect_list(F.struct("template_no", "template")))
        return templates.agg(F.transform(ordered, lambda t: t["template"]).alias("t")).scalar()
    return F.array(*[F.lit(t) for t in templates])


def expand_queries(
    queries: DataFrame,
    templates: DataFrame | Sequence[str] | None = None,
    num: int = ANCHORS_PER_QUERY,
    answers: DataFrame | None = None,
) -> DataFrame:
    """(ord, query) to (ord, category, anchors).

    Without help a query stands for itself: its fallback category and ``num``
    copies of it.  ``templates`` (sentences with ``{query}``, as a list or as a
    table (template_no, template)) are filled in per query.  ``answers`` (ord,
    category, variations) holds generated sentences; what an answer leaves out gets
    the documented defaults, and a query without an answer falls back; a second answer to a query
    raises.
    """
    query = F.col("query")
    base = queries.withColumn("category", fallback_category(query))
    if templates is None:
        base = base.withColumn("anchors", repeat_anchor(query, num))
    else:
        base = base.withColumn("anchors", _template_array(templates)).withColumn(
            "anchors", F.transform("anchors", lambda t: F.replace(t, F.lit("{query}"), query))
        )
    if answers is None:
        return base.drop("query")
    given = answers.groupBy(F.col("ord").alias("__ord")).agg(
        F.min(F.struct(defaulted(F.col("category"), DEFAULT_CATEGORY).alias("c"), F.col("variations").alias("v"))).alias("__a"), F.count("*").alias("__n")
    )
    twice = F.raise_error(F.concat(F.lit("more than one answer for ord "), F.col("__ord").cast("string"))).cast("string")
    given = given.select(
        "__ord", F.when(F.col("__n") > 1, twice).otherwise(F.col("__a.c")).alias("__category"), F.col("__a.v").alias("__variations")
    )
    joined = base.join(given, F.col("ord") == F.col("__ord"), "left")
    answered = F.col("__ord").isNotNull()
    picked = F.when(answered, F.coalesce("__variations", repeat_anchor(query, num))).otherwise(F.col("anchors"))
    return (
        joined.withColumn("category", F.when(answered, F.col("__category")).otherwise(F.col("category")))
        .withColumn("anchors", picked)
        .drop("query", "__ord", "__category", "__variations")
    )


def _fill(templates: Column, values: dict[str, Column]) -> Column:
    def sentence(template: Column) -> Column:
        for name, value in values.items():
            template = F.replace(template, F.lit("{" + name + "}"), value)
        return template

    return F.transform(templates, sentence)


def expand_fields(
    requests: DataFrame,
    templates: Sequence[str] = FIELD_TEMPLATES,
    category: str = DEFAULT_FIELDS_CATEGORY,
) -> DataFrame:
    """Structured criteria to one filter per request: adds ``category`` and ``anchors``.

    A field may list several values, separated by commas.  The first values fill every
    template; every further value of a field fills every template again, in place of the
    first.  A request whose fields are all
    blank gets no anchors, so it drops out when it is embedded.
    """
    given = F.struct(
        *[trim_and_compact(F.split(defaulted(F.col(f"fields.{name}"), ""), ",")).alias(name) for name in FIELDS]
    )
    every = F.array(*[F.lit(t) for t in templates])
    none = F.array().cast("array<string>")

    def further(values: Column, name: str, first: dict[str, Column]) -> Column:
        extra = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
        return F.flatten(F.transform(extra, lambda value: _fill(every, {**first, name: value})))

    def anchors(lists: Column) -> Column:
        # Bound once: the first value of every field, used in each sentence.
        firsts = F.struct(
            *[defaulted(F.get(lists[name], F.lit(0)), DEFAULT_FIELD).alias(name) for name in FIELDS]
        )

        def sentences(bound: Column) -> Column:
            first = {name: bound[name] for name in FIELDS}
            return F.flatten(F.array(_fill(every, first), *[further(lists[name], name, first) for name in FIELDS]))

        some = F.greatest(*[F.size(lists[name]) for name in FIELDS]) > 0
        return F.when(some, let(firsts, sentences)).otherwise(none)

    return requests.withColumn("category", F.lit(category)).withColumn("anchors", let(given, anchors))


def route_requests(
    requests: DataFrame,
    separators: str | None = None,
    query_templates: DataFrame | Sequence[str] | None = None,
    field_templates: Sequence[str] = FIELD_TEMPLATES,
    num: int = ANCHORS_PER_QUERY,
) -> DataFrame:
    """(request_id, ord, category, anchors) for requests of either kind.

    Natural-language requests give one filter per sub-query, the others one filter.
    """
    nl = defaulted(F.col("usedNaturalLanguage"), False)
    described = split_description(requests.filter(nl), separators)
    spoken = expand_queries(
        described.select("request_id", F.col("sub").cast("long").alias("ord"), "query"), query_templates, num
    )
    structured = expand_fields(requests.filter(~nl), field_templates)
    return spoken.select("request_id", "ord", "category", "anchors").unionByName(
        structured.select("request_id", F.lit(0).cast("long").alias("ord"), "category", "anchors")
    )


def build_filter_table(filters: DataFrame) -> DataFrame:
    """Filters ready to embed or to write: (ord, category, anchors), and request_id if there is one.

    With ``request_id`` the filters of all requests stay apart: ``ord`` becomes the request's place
    in their order, times 2**32, plus the place within the request.  Without it ``ord`` stays, and
    matching refuses a table in which one repeats.
    """
    if "request_id" not in filters.columns:
        return filters.select(F.col("ord").cast("long").alias("ord"), "category", "anchors")
    requests = filters.select("request_id").distinct()  # no more than there are filters, a small table
    numbered = requests.withColumn("__place", F.row_number().over(Window.orderBy("request_id")) - 1)
    numbered = numbered.withColumnRenamed("request_id", "__request")
    joined = filters.join(numbered, F.col("request_id").eqNullSafe(F.col("__request")))
    order = F.col("__place").cast("long") * F.lit(1 << 32) + F.col("ord")
    return joined.select("request_id", order.alias("ord"), "category", "anchors")


def count_anchors(filters: DataFrame) -> DataFrame:
    """How many anchors each filter has: (ord, category, n_anchors)."""
    return filters.select("ord", "category", F.size("anchors").alias("n_anchors"))
