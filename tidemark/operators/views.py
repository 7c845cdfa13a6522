"""The read side that is put together from several tables: postings with their history, attempts with their counts, queues, claims and profiles.

Each view is a plan over whole tables; a caller who wants one posting or document filters it and the filter reaches the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import lifecycle as lc
from . import evaluation

#: What a served extraction may have as its status, and what waits for a reader.
SERVING_STATUSES = ("validated", "needs_review")
INBOX_STATUSES = ("needs_review", "quarantined")
#: The codes of the check `accounting` that leave a record faithful, and the warning that is tolerated beside them.
BOOKKEEPING_CODES = ("coverage_unevidenced", "block_unaccounted", "context_requirement_language", "exclusion_requirement_language")
TOLERATED_WARNING = ("mentions", "skill_outside_demand")


def posting_details(life: lc.Lifecycle) -> DataFrame:
    """Every posting with its versions, array of (version, at) by time and version, and its events, array of structs by number.

    A posting without a version or an event has an empty array. Both histories are grouped by (board, uid), the key that the state has too."""
    key = ["board", "uid"]
    first = life.rows.where("vh IS NOT NULL").groupBy(*key, "vh").agg(F.min("at").alias("at"))
    versions = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", F.col("vh").alias("version")))).alias("versions"))
    told = F.struct("event_id", "kind", "at", "from_version", "to_version", "closed_after", "closed_by")
    history = life.events.groupBy(*key).agg(F.array_sort(F.collect_list(told)).alias("events"))
    found = life.postings.join(versions, key, "left").join(history, key, "left")
    return found.withColumns({c: F.coalesce(c, F.array().cast(found.schema[c].dataType)) for c in ("versions", "events")})


def attempt_counts(life: lc.Lifecycle, observations: DataFrame) -> DataFrame:
    """What each attempt saw and changed: observed, parsed, failed, pending, duplicate_ids and its events by kind; all 0 for an error.

    duplicate_ids are rows beyond the first of a uid in its attempt."""
    key = ["board", "attempt_id"]
    a = life.attempts.select(*key, "at", "health", "is_error")
    per_uid = observations.groupBy(*key, "uid").agg(F.min_by("status", "pos").alias("status"), F.count("*").alias("_n"))
    status = lambda s: F.count_if(F.col("status") == s)
    seen = per_uid.groupBy(*key).agg(
        F.count("*").alias("observed"), status("ok").alias("parsed"), status("failed").alias("failed"), status("pending").alias("pending"),
        (F.sum("_n") - F.count("*")).alias("duplicate_ids"),
    )
    kinds = ("opened", "changed", "closed", "reopened")
    moved = lc.unnumbered(life).groupBy(*key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    counts = ("observed", "parsed", "failed", "pending", "duplicate_ids", *kinds)
    found = a.join(seen, key, "left").join(moved, key, "left")
    return found.select(*key, "at", "health", *[F.when(F.col("is_error"), 0).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in counts])


def carried(touches: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The last value that a touch brought: one without a value keeps the one before. Combined before the shuffle; null if none brought any."""
    return touches.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def title_matches(title: Column, pattern: str | None) -> Column:
    """Case-insensitive search by a pattern; without one every title passes, null too."""
    return F.lit(True) if pattern is None else F.coalesce(title.rlike(f"(?i){pattern}"), F.lit(False))


def document_reach(documents: DataFrame, versions: DataFrame, postings: DataFrame) -> DataFrame:
    """Per document the versions that render to it, the postings that ever had one, and those that have one and are open.

    documents: document_hash, version; versions: board, uid, version; postings: board, uid, state, current_version. A version on many
    postings and a posting with many versions of a document count once each."""
    key = ["document_hash", "board", "uid"]
    fan = documents.join(versions, "version").join(postings.select("board", "uid", "state", "current_version"), ["board", "uid"])
    live = (F.col("state") == "open") & (F.col("current_version") == F.col("version"))
    per_posting = fan.groupBy(*key).agg(F.max(live.cast("int")).alias("_live"))
    n_postings = per_posting.groupBy("document_hash").agg(F.count("*").alias("n_postings"), F.sum("_live").alias("n_open"))
    n_versions = fan.select("document_hash", "version").distinct().groupBy("document_hash").agg(F.count("*").alias("n_versions"))
    return n_versions.join(n_postings, "document_hash")


def inbox(extractions: DataFrame, prompt: str) -> DataFrame:
    """Extractions that wait for a reader, those without a validated one of the current prompt first, then by age."""
    done = extractions.where((F.col("prompt_version") == prompt) & (F.col("status") == "validated")).select("document_hash").distinct()
    waiting = extractions.where(F.col("status").isin(*INBOX_STATUSES))
    flagged = waiting.join(done.withColumn("_done", F.lit(True)), "document_hash", "left")
    return flagged.withColumn("superseded", F.coalesce("_done", F.lit(False))).drop("_done").orderBy("superseded", "updated_at", "document_hash")


def attempt_history(attempts: DataFrame, config: dict[str, str], by: str = "document_hash") -> DataFrame:
    """The attempts under one configuration, as an array of each document in order of start and number; others are another identity."""
    under = attempts
    for column, value in config.items():
        under = under.where(F.col(column) == value)
    rest = [c for c in under.columns if c not in (by, *config)]
    order = ["started_at", "attempt_no"]
    one = F.struct(*order, *[c for c in rest if c not in order])
    return under.groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("attempts"))


def refuter_verbs(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("actor").startswith("refuter:")).groupBy("verb").agg(F.count("*").alias("n"))


def mention_context(profile: Column, surface: Column, area_kind: Column) -> Column:
    """struct(section_heading, modality) of the first statement, in record order, that the surface links and that is of the kind.

    profile: JSON text. Null if there is no such statement or it has no key section_heading (an older record); a heading that is
    null and a statement without a quote give a struct with nulls. Text that is no JSON is a record without statements."""
    return F.get(mention_contexts(profile, F.array(F.struct(surface.alias("surface"), area_kind.alias("kind")))), F.lit(0))


def mention_contexts(profile: Column, wanted: Column) -> Column:
    """mention_context of each wanted struct(surface, kind), in order. The profile is parsed once and each object read once, however many are wanted."""
    items = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    text = lambda v, path: F.try_variant_get(v, path, "string")
    once = lambda value, read: F.get(F.transform(F.array(value), read), F.lit(0))
    ids = lambda m: F.coalesce(F.try_variant_get(m, "$.statement_ids", "array<string>"), F.array().cast("array<string>"))
    mention = lambda m: F.struct(F.lower(text(m, "$.surface")).alias("surface"), ids(m).alias("ids"))
    statement = lambda s: F.struct(
        text(s, "$.id").alias("id"), text(s, "$.kind").alias("kind"), F.struct(text(s, "$.section_heading").alias("section_heading"), text(s, "$.modality_evidence[0].text").alias("modality")).alias("told"))
    headed = lambda s: F.try_variant_get(s, "$.section_heading", "variant").isNotNull()
    read = lambda v: F.struct(F.transform(items(v, "$.mentions"), mention).alias("mentions"), F.transform(F.filter(items(v, "$.statements"), headed), statement).alias("statements"))

    def of(record: Column, w: Column) -> Column:
        linked = once(F.lower(w["surface"]), lambda low: F.flatten(F.transform(F.filter(record["mentions"], lambda m: m["surface"] == low), lambda m: m["ids"])))
        fits = once(linked, lambda links: F.filter(record["statements"], lambda s: F.coalesce(F.array_contains(links, s["id"]) & (s["kind"] == w["kind"]), F.lit(False))))
        return F.get(fits, F.lit(0))["told"]

    return once(once(F.try_parse_json(profile), read), lambda record: F.transform(wanted, lambda w: of(record, w)))


def served_profiles(extractions: DataFrame, titles: DataFrame, prompt: str) -> DataFrame:
    """The one extraction that stands for each document, if it may be served and has a profile, with its title and whether it is historical.

    The choice comes before the gate: a quarantined row of the current prompt hides an older one."""
    chosen = evaluation.profile_choice(extractions, prompt)
    return chosen.where(F.col("status").isin(*SERVING_STATUSES) & F.col("profile").isNotNull()).join(titles, "document_hash", "left")


def bookkeeping_gaps(candidates: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """The failing findings of candidates whose block accounting is all that is wrong with them.

    candidates: key, extracted, accounted, blocks; findings: key, check, code, severity and more. A candidate counts if it extracted
    anything, accounts for more than half of its blocks, and has no finding but of those codes (the tolerated warning aside)."""
    warning = F.coalesce(F.col("severity") == "warning", F.lit(False))
    tolerated = warning & (F.col("check") == TOLERATED_WARNING[0]) & (F.col("code") == TOLERATED_WARNING[1])
    bookkeeping = (F.col("check") == "accounting") & F.col("code").isin(*BOOKKEEPING_CODES)
    harmless = F.coalesce(tolerated | bookkeeping, F.lit(False))
    sound = findings.groupBy(key).agg(F.min(harmless.cast("int")).alias("_harmless")).where("_harmless = 1")
    whole = candidates.where("extracted >= 1 AND 2 * accounted > blocks").select(key).join(sound.select(key), key)
    return findings.where(~warning).join(whole, key, "left_semi")


def value_signature(family: Column, scope: Column, date_kind: Column, component: Column, state: Column, quantity: Column, money: Column, date: Column) -> Column:
    """A derived value with its scope as one comparable string; absent parts read as None, absent scope and kinds as nothing.

    quantity: struct(dimension, comparison, min_value, max_value, inclusive_min, inclusive_max, unit); money: struct(comparison, min_amount,
    max_amount, currency, period); date: struct(date, candidates). Any of the three may be null and then adds nothing."""
    bar = F.lit("|")
    told = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    truth = lambda c: F.when(c.isNull(), "None").when(c, "True").otherwise("False")
    number = lambda c: told(F.regexp_replace(c.cast("string"), r"\.0$", ""))
    blank = lambda c: F.coalesce(c, F.lit(""))
    q = F.concat_ws("|", F.lit("q"), quantity["dimension"], quantity["comparison"], number(quantity["min_value"]), number(quantity["max_value"]), truth(quantity["inclusive_min"]), truth(quantity["inclusive_max"]), told(quantity["unit"]))
    m = F.concat_ws("|", F.lit("m"), money["comparison"], told(money["min_amount"]), told(money["max_amount"]), told(money["currency"]), told(money["period"]))
    d = F.concat_ws("|", F.lit("d"), told(date["date"]), F.concat_ws(",", date["candidates"].cast("array<string>")))
    head = F.concat(family, bar, blank(scope), bar, blank(date_kind), bar, blank(component), bar, state)
    return F.concat(head, *[F.when(part.isNull(), "").otherwise(F.concat(bar, text)) for part, text in ((quantity, q), (money, m), (date, d))])


def evaluation_name(name: Column) -> Column:
    """A name for comparison: lower case, only word characters and + # . /, single blanks."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)[^\w+#./ ]", " "), r"(?U)\s+", " "))
