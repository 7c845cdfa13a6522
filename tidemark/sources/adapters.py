"""Job-board payloads as posting records, one projection per source over VARIANT values.

Input: bodies (attempt_id, body) of single-phase sources or of list pages, and for two-phase sources details (attempt_id, source_id,
body). Output: RECORD columns. A body that is not the promised shape is an envelope error of its whole attempt (see envelopes); a
record that lacks an id, title or description is failed on its own, and the others are unaffected.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Uid prefixes, the list inside each envelope, and the total beside it.
PREFIXES = {"greenhouse": "gh", "lever": "lv", "ashby": "ab", "workday": "wd", "oraclehcm": "oh", "amazonjobs": "az", "smartrecruiters": "sr", "eightfold": "ef"}
LISTS = {
    "greenhouse": ("$.jobs", None), "lever": ("$", None), "ashby": ("$.jobs", None), "workday": ("$.jobPostings", "$.total"), "oraclehcm": ("$.items[0].requisitionList", "$.items[0].TotalJobsCount"),
    "amazonjobs": ("$.jobs", "$.hits"), "smartrecruiters": ("$.content", "$.totalFound"), "eightfold": ("$.positions", "$.count"),
}
TWO_PHASE = ("workday", "oraclehcm", "smartrecruiters", "eightfold")
RECORD = ("title", "description_html", "locations", "workplace_type", "is_remote", "department", "team", "employment_type", "compensation", "url", "apply_url", "source_created_at", "source_updated_at")


#: Rows whose texts are Python strings at one time.
_AT_ONCE = 200


@F.arrow_udf(StringType())
def _resolved(html: pa.Array) -> pa.Array:
    from html import unescape

    parts = (html.slice(at, _AT_ONCE).to_pylist() for at in range(0, len(html), _AT_ONCE))
    return pa.concat_arrays([pa.array([None if t is None else unescape(t) for t in part], pa.string()) for part in parts] or [pa.array([], pa.string())])


def unescaped(html: Column) -> Column:
    """Character references resolved; only a text that has an ampersand goes to Python, and there a few hundred at a time."""
    return F.coalesce(_resolved(F.when(html.contains("&"), html)), html)


def text(v: Column, path: str) -> Column:
    """A string at a path, trimmed of all white space; null if it is another type or empty."""
    value = F.try_variant_get(v, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.when((kind == "STRING") & (trimmed != ""), trimmed)


def number(v: Column, path: str, kind: str = "double") -> Column:
    return F.when(~F.schema_of_variant(F.try_variant_get(v, path, "variant")).isin("STRING", "BOOLEAN"), F.try_variant_get(v, path, kind))


def items(v: Column, path: str) -> Column:
    """An array at a path; empty if it is anything else."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def locations(*values: Column) -> Column:
    flat = F.flatten(F.array(*values))
    return F.array_sort(F.array_distinct(F.filter(flat, lambda x: x.isNotNull())))


def each(v: Column, path: str, inner: str = "$") -> Column:
    return F.transform(items(v, path), lambda x: text(x, inner))


def employment(v: Column) -> Column:
    key = F.lower(F.regexp_replace(v, r"[\s-]+", ""))
    return F.when(key == "fulltime", "full_time").when(key == "parttime", "part_time").otherwise(F.lower(F.regexp_replace(v, r"[\s-]+", "_")))


def instant(v: Column) -> Column:
    """ISO text as an instant; text without a zone is UTC (the session's zone)."""
    return F.try_to_timestamp(v)


def _pay(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    return F.when(low.isNotNull() | high.isNotNull(), F.struct(low.alias("min"), high.alias("max"), currency.alias("currency"), interval.alias("interval")))


_NO_PAY = "struct<min:double,max:double,currency:string,interval:string>"


def _record(**found: Column) -> dict[str, Column]:
    kinds = {"locations": "array<string>", "is_remote": "boolean", "compensation": _NO_PAY, "source_created_at": "timestamp", "source_updated_at": "timestamp"}
    return {c: found.get(c, F.lit(None)).cast(kinds.get(c, "string")) for c in RECORD}


def greenhouse(p: Column) -> dict[str, Column]:
    return _record(
        title=text(p, "$.title"), description_html=unescaped(F.try_variant_get(p, "$.content", "string")), locations=locations(F.array(text(p, "$.location.name")), each(p, "$.offices", "$.location")),
        department=text(p, "$.departments[0].name"), url=text(p, "$.absolute_url"), source_created_at=instant(text(p, "$.first_published")), source_updated_at=instant(text(p, "$.updated_at")),
    )


def lever(p: Column) -> dict[str, Column]:
    sections = F.transform(items(p, "$.lists"), lambda x: F.concat(F.lit("<h3>"), F.coalesce(text(x, "$.text"), F.lit("")), F.lit("</h3><ul>"), F.coalesce(text(x, "$.content"), F.lit("")), F.lit("</ul>")))
    parts = F.array_join(F.concat(F.array(text(p, "$.opening"), text(p, "$.descriptionBody")), sections, F.array(text(p, "$.additional"))), "")
    workplace = F.lower(text(p, "$.workplaceType"))
    many = locations(each(p, "$.categories.allLocations"))
    pay = _pay(number(p, "$.salaryRange.min"), number(p, "$.salaryRange.max"), text(p, "$.salaryRange.currency"), text(p, "$.salaryRange.interval"))
    return _record(
        title=text(p, "$.text"), description_html=F.when(parts != "", parts), locations=F.when(F.size(many) > 0, many).otherwise(locations(F.array(text(p, "$.categories.location")))), workplace_type=workplace,
        is_remote=workplace == "remote", department=text(p, "$.categories.team"), employment_type=employment(text(p, "$.categories.commitment")), compensation=pay, url=text(p, "$.hostedUrl"), apply_url=text(p, "$.applyUrl"),
        source_created_at=F.timestamp_millis(number(p, "$.createdAt", "long")),
    )


def ashby(p: Column) -> dict[str, Column]:
    bounded = F.filter(items(p, "$.compensation.summaryComponents"), lambda c: (text(c, "$.compensationType") == "Salary") & (number(c, "$.minValue").isNotNull() | number(c, "$.maxValue").isNotNull()))
    c = F.get(bounded, F.lit(0))
    spelled = text(c, "$.interval")
    interval = F.when(spelled == "1 YEAR", "year").when(spelled == "1 MONTH", "month").when(spelled == "1 WEEK", "week").when(spelled == "1 DAY", "day").when(spelled == "1 HOUR", "hour").otherwise(spelled)
    remote = F.try_variant_get(p, "$.isRemote", "variant")
    return _record(
        title=text(p, "$.title"), description_html=F.try_variant_get(p, "$.descriptionHtml", "string"), locations=locations(F.array(text(p, "$.location")), each(p, "$.secondaryLocations", "$.location")), workplace_type=F.lower(text(p, "$.workplaceType")),
        is_remote=F.when(F.schema_of_variant(remote) == "BOOLEAN", F.try_variant_get(p, "$.isRemote", "boolean")), department=text(p, "$.department"), team=text(p, "$.team"), employment_type=employment(text(p, "$.employmentType")),
        compensation=_pay(number(c, "$.minValue"), number(c, "$.maxValue"), text(c, "$.currencyCode"), interval), url=text(p, "$.jobUrl"), apply_url=text(p, "$.applyUrl"), source_created_at=instant(text(p, "$.publishedAt")),
    )


def amazonjobs(p: Column) -> dict[str, Column]:
    labelled = [F.concat(F.lit(f"<h2>{h}</h2>\n"), text(p, f"$.{k}")) for k, h in (("basic_qualifications", "Basic qualifications"), ("preferred_qualifications", "Preferred qualifications"))]
    posted = F.regexp_replace(text(p, "$.posted_date"), r"\s+", " ")
    whole = F.concat_ws("\n", text(p, "$.description"), *labelled)
    return _record(
        title=text(p, "$.title"), description_html=F.when(text(p, "$.description").isNotNull(), whole), locations=locations(F.array(text(p, "$.normalized_location"))), department=text(p, "$.job_category"), team=text(p, "$.team"),
        employment_type=text(p, "$.job_schedule_type"), url=F.concat(F.lit("https://www.amazon.jobs"), text(p, "$.job_path")), source_created_at=F.try_to_timestamp(posted, F.lit("MMMM d, yyyy")),
    )


def workday(p: Column) -> dict[str, Column]:
    q = lambda k: text(p, f"$.jobPostingInfo.{k}")
    return _record(
        title=q("title"), description_html=F.try_variant_get(p, "$.jobPostingInfo.jobDescription", "string"), locations=locations(F.array(q("location")), each(p, "$.jobPostingInfo.additionalLocations")), employment_type=employment(q("timeType")),
        url=q("externalUrl"), apply_url=q("externalUrl"), source_created_at=instant(q("startDate")),
    )


def oraclehcm(p: Column) -> dict[str, Column]:
    q = lambda k: text(p, f"$.items[0].{k}")
    parts = F.concat_ws("\n", *[q(k) for k in ("ExternalDescriptionStr", "ExternalResponsibilitiesStr", "ExternalQualificationsStr")])
    places = F.transform(items(p, "$.items[0].workLocation"), lambda w: F.concat_ws(", ", text(w, "$.TownOrCity"), text(w, "$.Region2")))
    return _record(title=q("Title"), description_html=F.when(parts != "", parts), locations=locations(F.array(q("PrimaryLocation")), F.transform(places, lambda x: F.when(x != "", x))), source_created_at=instant(q("ExternalPostedStartDate")))


def smartrecruiters(p: Column) -> dict[str, Column]:
    order = ("companyDescription", "jobDescription", "qualifications", "additionalInformation")
    sections = F.filter(F.array(*[F.struct(text(p, f"$.jobAd.sections.{k}.title").alias("h"), text(p, f"$.jobAd.sections.{k}.text").alias("t")) for k in order]), lambda s: s["t"].isNotNull())
    headed = F.array_join(F.transform(sections, lambda s: F.when(s["h"].isNotNull(), F.concat(F.lit("<h2>"), s["h"], F.lit("</h2>\n"), s["t"])).otherwise(s["t"])), "\n")
    place = F.coalesce(text(p, "$.location.fullLocation"), text(p, "$.location.city"))
    return _record(
        title=text(p, "$.name"), description_html=F.when(F.size(sections) == 1, F.get(sections, F.lit(0))["t"]).when(F.size(sections) > 1, headed), locations=locations(F.array(place)),
        is_remote=F.when(F.try_variant_get(p, "$.location.remote", "boolean"), True), department=text(p, "$.function.label"), team=text(p, "$.department.label"), employment_type=text(p, "$.typeOfEmployment.label"),
        url=text(p, "$.postingUrl"), apply_url=text(p, "$.applyUrl"), source_created_at=instant(text(p, "$.releasedDate")),
    )


def eightfold(p: Column) -> dict[str, Column]:
    seconds = lambda k: F.timestamp_seconds(number(p, k, "long"))
    many = locations(each(p, "$.locations"))
    return _record(
        title=text(p, "$.name"), description_html=text(p, "$.job_description"), locations=F.when(F.size(many) > 0, many).otherwise(locations(F.array(text(p, "$.location")))), workplace_type=text(p, "$.work_location_option"),
        department=text(p, "$.department"), team=text(p, "$.business_unit"), employment_type=text(p, "$.type"), url=text(p, "$.canonicalPositionUrl"), source_created_at=seconds("$.t_create"), source_updated_at=seconds("$.t_update"),
    )


ADAPTERS: dict[str, Callable[[Column], dict[str, Column]]] = {f.__name__: f for f in (greenhouse, lever, ashby, amazonjobs, workday, oraclehcm, smartrecruiters, eightfold)}


def row_id(source: str, p: Column) -> Column:
    """The id of a list row, as text."""
    whole = lambda k: F.try_variant_get(p, k, "string")
    return {"workday": F.coalesce(text(p, "$.bulletFields[0]"), text(p, "$.externalPath")), "oraclehcm": whole("$.Id"), "amazonjobs": text(p, "$.id_icims"), "smartrecruiters": text(p, "$.id")}.get(source, whole("$.id"))


def envelopes(bodies: DataFrame, source: str) -> DataFrame:
    """attempt_id and whether its body has the promised shape; total as listed."""
    path, total = LISTS[source]
    v = F.try_parse_json("body")
    good = F.try_variant_get(v, path, "array<variant>").isNotNull()
    told = number(v, total, "long") if total else F.lit(None).cast("long")
    return bodies.select("attempt_id", v.alias("_v"), good.alias("_good"), told.alias("total")).select("attempt_id", "_v", "total", (F.col("_good") & (F.lit(total is None) | F.col("total").isNotNull())).alias("envelope_ok"))


def listed(bodies: DataFrame, source: str) -> DataFrame:
    """Rows of all good envelopes: attempt_id, index, source_id, payload."""
    rows = envelopes(bodies, source).where("envelope_ok").select("attempt_id", F.posexplode(F.try_variant_get("_v", LISTS[source][0], "array<variant>")).alias("index", "payload"))
    return rows.withColumn("source_id", row_id(source, F.col("payload")))


def records(source: str, bodies: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """attempt_id, index, source_id, status (ok, failed, pending) and the record; of two-phase sources the details fill the rows."""
    rows = listed(bodies, source)
    if source in TWO_PHASE:
        found = details.select("attempt_id", "source_id", F.try_parse_json("body").alias("_detail"), F.lit(True).alias("_has"))
        rows = rows.where("source_id is not null").join(found, ["attempt_id", "source_id"], "left").withColumn("payload", F.col("_detail"))
    else:
        rows = rows.withColumn("_has", F.lit(True))
    made = rows.select("attempt_id", "index", "source_id", "_has", *[c.alias(k) for k, c in ADAPTERS[source](F.col("payload")).items()])
    complete = F.col("source_id").isNotNull() & F.col("title").isNotNull() & F.col("description_html").isNotNull()
    return made.withColumn("status", F.when(F.col("_has").isNull(), "pending").when(complete, "ok").otherwise("failed")).drop("_has")


def uid(source: str, board: Column, source_id: Column) -> Column:
    return F.concat_ws(":", F.lit(PREFIXES[source]), board, source_id)
