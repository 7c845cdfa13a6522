"""Assembly of extraction records: what a model emitted, bound to its document, derived and sealed, or all of its errors at once.

An emit is taken apart into rows of references (doc_id, slot, pos): a slot is a place of the record that cites. References are bound by the joins of
functions.resolving, facts are derived on rows by the grammars, and both go back to their document as maps by slot and by place, from which one
expression builds the record in its own order. Every shuffle after the binding is by doc_id; no row holds more than one document's record.
What references bind to is written once to the shared folder, as facts and slots read it. What the record's parts look up in the whole emit is a
column of its row, and the hash is taken from the parts, not from the record again.

Defined results: an emit that is no JSON object has the error `emit: not an object`; a null text has no blocks, so whatever is cited is unknown; lists
that are missing or no lists are empty; an emit of `{}` is a record without objects. Equal doc_ids are the caller's fault: they are taken as one."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import grammar, resolving, texts
from ..plans.store import written
from .contract import INVISIBLE, normalized_key
from .sealing import is_object, listed, text

#: Families of facts by the key of their presence, families about authorization, and what a fact's evidence may cite beside its value.
PRESENCE_KEY = {"experience": "experience", "compensation": "compensation", "quantity": "quantities", "date": "dates"}
AUTHORIZATION = ["sponsorship", "citizenship", "work_authorization"]
ASPECTS = ["comparison", "unit", "currency", "component", "applicability"]
#: Fixed value: a line above an amount is part of its label up to this length.
LABEL_MOST = 60

#: How a slot cites: a list that must be there, a list or nothing, one reference that may bind leniently.
NEEDED, OPTIONAL, ONE = "needed", "optional", "one"
FACTS = "facts.entries"
SLOTS = {
    "statements": {"evidence": NEEDED, "modality_evidence": OPTIONAL, "polarity_evidence": OPTIONAL},
    "relations.groups": {"evidence": OPTIONAL},
    "relations.conditions": {"evidence": NEEDED},
    "relations.example_sets": {"evidence": OPTIONAL},
    "relations.tracks.items": {"name_evidence": NEEDED, "evidence": NEEDED},
    FACTS: {"evidence.value": NEEDED, **{f"evidence.{a}": OPTIONAL for a in ASPECTS}, "scope.evidence": OPTIONAL},
    "mentions": {"evidence": ONE},
    "areas": {"evidence": OPTIONAL},
    "block_accounting": {"evidence": OPTIONAL},
}
SINGLE_SLOTS = [
    "source_assessment.evidence",
    *[f"facts.presence.{f}.evidence" for f in [*PRESENCE_KEY.values(), *AUTHORIZATION]],
    *[f"facts.presence.{f}.polarity_evidence" for f in AUTHORIZATION],
    "relations.tracks.selection_evidence",
]


def _get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def _place(of: str, i: Column) -> Column:
    return F.concat(F.lit(f"{of}["), i.cast("string"), F.lit("]"))


def _slots(emit: Column) -> Column:
    """All slots of an emit, in the record's order."""
    none = F.lit(None).cast("string")
    row = lambda slot, value, kind, family=none: F.struct(slot.alias("slot"), value.alias("value"), F.lit(kind).alias("kind"), family.alias("family"))
    parts = [F.array(*[row(F.lit(s), _get(emit, s), OPTIONAL) for s in SINGLE_SLOTS])]
    cited = lambda of, fields: lambda x, i: F.array(*[row(F.concat(_place(of, i), F.lit(f".{f}")), _get(x, f), kind, text(x, "$.family") if of == FACTS else none) for f, kind in fields.items()])
    for of, fields in SLOTS.items():
        parts.append(F.flatten(F.transform(listed(emit, f"$.{of}"), cited(of, fields))))
    issue = lambda at: lambda y, j: row(F.concat(at, _place(".unresolved", j), F.lit(".evidence")), _get(y, "evidence"), NEEDED)
    parts.append(F.flatten(F.transform(listed(emit, "$.statements"), lambda x, i: F.transform(listed(x, "$.unresolved"), issue(_place("statements", i))))))
    return F.concat(*parts)


def references(emits: DataFrame) -> DataFrame:
    """doc_id, rank (the slot's place among all), slot, pos, ref_id (the reference's path), block_id, quote, occurrence, lenient, error (of its shape), family (of
    the fact whose slot it is), dollar (what a bare $ means in its document)."""
    slots = emits.withColumn("dollar", _dollar(F.col("emit"), F.col("text"))).select("doc_id", "dollar", F.posexplode(_slots(F.col("emit"))).alias("rank", "s")).select("doc_id", "dollar", "rank", "s.*")
    items = F.when(F.col("kind") == ONE, F.array("value")).otherwise(F.try_variant_get("value", "$", "array<variant>"))
    nothing = F.col("value").isNull() | F.is_variant_null("value")
    cites = slots.where((F.col("kind") != OPTIONAL) | ~nothing).withColumn("_items", items)
    # one pass: what is no list has a row without an item
    each = cites.select("doc_id", "dollar", "rank", "slot", "family", "kind", F.col("_items").isNull().alias("_odd"), F.posexplode_outer("_items").alias("pos", "item")).where("_odd or pos is not null")
    path = F.when(F.col("_odd") | (F.col("kind") == ONE), F.col("slot")).otherwise(F.concat("slot", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    error = F.when(F.col("_odd"), "expected a non-empty list of references").when(~is_object(F.col("item")), "expected a reference object")
    return each.select(
        "doc_id", "rank", "slot", "family", F.coalesce("pos", F.lit(0)).alias("pos"), path.alias("ref_id"), text(F.col("item"), "$.block_id").alias("block_id"), text(F.col("item"), "$.text").alias("quote"),
        F.try_variant_get("item", "$.occurrence", "int").alias("occurrence"), (F.col("kind") == ONE).alias("lenient"), error.alias("error"), "dollar")


def contexts(blocks: DataFrame) -> DataFrame:
    """The blocks with section_heading and label (where the block has a digit: its line, after a short line above it)."""
    own = F.trim("text")
    above = F.lag(own).over(Window.partitionBy("doc_id").orderBy("start"))
    label = F.when((above != "") & (F.length(above) <= LABEL_MOST), F.concat_ws(" ", above, own)).otherwise(own)
    return texts.under_headings(blocks).withColumn("label", F.when(F.col("text").rlike(r"(?U)\d"), label))


def _dollar(emit: Column, text_: Column) -> Column:
    """What a bare $ means in a document whose emit has a fact about pay, by its lines; others are not searched."""
    paid = F.exists(listed(emit, "$.facts.entries"), lambda x: F.coalesce(text(x, "$.family") == "compensation", F.lit(False)))
    return F.when(paid, F.when(~F.exists(F.split(text_, "\n", -1), grammar.other_dollar), "USD"))


@F.pandas_udf(ArrayType(StringType()))
def _character_errors(emit: pd.Series) -> pd.Series:
    """Paths of the strings that hold a character no reader sees; quotes, which are the document's, only those that no store holds."""
    def walk(path, node, quoted):
        if isinstance(node, str):
            unseen = {c for c in node if c not in "\n\t" and (unicodedata.category(c) in ("Cc", "Cf", "Co", "Cn", "Cs") if not quoted else ord(c) < 0x20)}
            if unseen:
                yield f"{path}: control character {','.join(f'U+{ord(c):04X}' for c in sorted(unseen))} in emitted string"
        elif isinstance(node, dict):
            for k, v in node.items():
                yield from walk(f"{path}.{k}", v, k == "section_heading" or (k == "text" and "block_id" in node))
        elif isinstance(node, list):
            for i, v in enumerate(node):
                yield from walk(f"{path}[{i}]", v, quoted)

    return emit.map(lambda s: [] if s is None else list(walk("emit", json.loads(s), False)))


def _cited(refs: Column) -> Column:
    """The cited texts, by their spans, joined by a blank; null where nothing is cited."""
    return F.array_join(F.transform(F.array_sort(F.transform(refs, lambda r: F.struct(r["start"], r["end"], r["text"]))), lambda r: r["text"]), " ")


def _derived() -> Column:
    """The reading of a fact from its cited spans: what no grammar reads is present_unparsed, never dropped."""
    cited = lambda aspect: F.col(f"_{aspect}")
    value = F.coalesce(cited("value"), F.lit(""))
    is_quantity, is_money = F.col("family").isin("experience", "quantity"), F.col("family") == "compensation"
    quantity = F.when(is_quantity, grammar.quantity(value, cited("comparison"), cited("unit"), plus_is_floor=True))
    money = F.when(is_money, grammar.money(value, cited("comparison"), cited("currency"), cited("unit"), F.coalesce("_label", F.lit("")), F.col("_dollar")))
    date = F.when(~F.coalesce(is_quantity | is_money, F.lit(False)), grammar.date(value))
    read = F.coalesce(quantity.isNotNull() | money.isNotNull() | date["date"].isNotNull(), F.lit(False))
    state = F.when(read, "parsed").when(date.isNotNull(), "ambiguous").otherwise("present_unparsed")
    return F.struct(state.alias("state"), quantity.alias("quantity"), money.alias("money"), date.alias("date"))


def _bound(emits: DataFrame) -> DataFrame:
    """The references with what they bind to: ref (null if there is an error) and error, narrow rows in which a text is what one reference cites."""
    blocks, refs = contexts(texts.annotate(emits)), references(emits).withColumnRenamed("error", "_shape")
    found = resolving.resolved(refs, blocks, "lenient", ("rank", "slot", "pos", "family", "dollar", "_shape"), ("section_heading", "label")).withColumn("error", F.coalesce("_shape", "error"))
    ref = F.struct("pos", "block_id", "text", "start", "end", "occurrence", "section_heading")
    return found.select(
        "doc_id", "rank", "slot", "pos", "ref_id", "family", F.when(F.col("error").isNull(), ref).alias("ref"), "error", F.when(F.col("slot").startswith(FACTS), F.struct("label", "dollar")).alias("pay"))


def _by_slot(bound: DataFrame) -> DataFrame:
    """Per document: bound (slot to its bound references) and errors (of binding, in the record's order)."""
    message = F.when(F.col("error").isNotNull(), F.struct("rank", "pos", F.concat_ws(": ", "ref_id", "error").alias("m")))
    rows = bound.select("doc_id", "slot", "ref", message.alias("_wrong")).repartition("doc_id")
    slots = rows.groupBy("doc_id", "slot").agg(F.array_sort(F.collect_list("ref")).alias("refs"), F.collect_list("_wrong").alias("_wrong"))
    return slots.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "refs"))).alias("bound"),
        F.transform(F.array_sort(F.flatten(F.collect_list("_wrong"))), lambda e: e["m"]).alias("errors"))


def _facts(bound: DataFrame) -> DataFrame:
    """Per document: derived, the readings of the entries that cite anything, by their places."""
    of = bound.where(F.col("slot").startswith(FACTS) & F.col("ref").isNotNull()).withColumns({
        "at": F.regexp_extract("slot", r"\[(\d+)\]", 1).cast("int"), "aspect": F.regexp_extract("slot", r"\]\.evidence\.(\w+)$", 1)})
    cites = lambda aspect: F.collect_list(F.when(F.col("aspect") == aspect, F.col("ref")))
    first = F.min_by("pay", F.when(F.col("aspect") == "value", F.struct("ref.start", "pos")))
    rows = of.groupBy("doc_id", "at").agg(F.first("family").alias("family"), first.alias("_pay"), *[cites(a).alias(a) for a in ["value", *ASPECTS]])
    shown = {f"_{a}": F.when(F.size(a) > 0, _cited(F.col(a))) for a in ["value", *ASPECTS]}
    rows = rows.select("doc_id", "at", "family", F.col("_pay.label").alias("_label"), F.col("_pay.dollar").alias("_dollar"), *[c.alias(k) for k, c in shown.items()])
    return rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("at", _derived().alias("d")))).alias("derived"))


def _object(**parts: Column | str | None) -> Column:
    """An object of the record: its keys are sorted, as in canonical JSON."""
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(k) for k, c in sorted(parts.items())])


def _let(value: Column, use) -> Column:
    """use(value), the value being evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shown(refs: Column) -> Column:
    """Bound references as the record has them."""
    return F.transform(refs, _one)


def _one(r: Column) -> Column:
    return _object(block_id=r["block_id"], text=r["text"], span=F.array(r["start"], r["end"]), occurrence=r["occurrence"])


def _texts(values: Column, path: str) -> Column:
    """The strings at a path of each, without what is none."""
    return F.filter(F.transform(values, lambda x: text(x, path)), lambda x: x.isNotNull())


def _links(ids: Column, known: str) -> Column:
    """Links, and whether each is live: names an id of the column `known`, which is found once a document and not once a link."""
    return F.transform(ids, lambda x: F.struct(x.alias("id"), F.coalesce(F.array_contains(F.col(known), text(x)), F.lit(False)).alias("live")))


def _pruned(ids: Column, known: str) -> Column:
    """Links without the dangling ones, if one link is live; else as they are."""
    kept = lambda links: F.when(F.exists(links, lambda x: x["live"]), F.filter(links, lambda x: x["live"])).otherwise(links)["id"]
    return _let(_links(ids, known), kept)


def _lost(path: Column, ids: Column, known: str) -> Column:
    """The links that pruning drops, as (path, ref_id)."""
    dead = lambda links: F.filter(links, lambda x: ~x["live"] & F.exists(links, lambda y: y["live"]))
    return F.transform(_let(_links(ids, known), dead), lambda x: F.struct(path.alias("path"), x["id"].alias("ref_id")))


def _unread() -> Column:
    """What an entry that cites nothing derives to, in the same shape."""
    nothing = F.from_json(F.lit("{}"), "quantity string, money string, date string")
    return F.to_variant_object(F.struct(F.lit("present_unparsed").alias("state"), nothing["quantity"].alias("quantity"), nothing["money"].alias("money"), nothing["date"].alias("date")))


def _known(emit: Column) -> dict[str, Column]:
    """What the parts of a record look up in the whole emit, as columns of its row, so that it is found once."""
    ids = {f"_{of[:-1]}_ids": _texts(listed(emit, f"$.{of}"), "$.id") for of in ("statements", "mentions")}
    return ids | {"_families": F.transform(listed(emit, "$.facts.entries"), lambda x: text(x, "$.family"))}


def _parts(emit: Column) -> dict[str, Column]:
    """The parts of the record of one row (emit, bound, derived, document_hash and what _known gives), and `dropped_links`; not yet sealed."""
    bound = lambda slot: F.try_element_at("bound", slot)
    needed = lambda slot: F.coalesce(_shown(bound(slot)), F.from_json(F.lit("[]"), "array<struct<block_id:string,occurrence:int,span:array<int>,text:string>>"))
    optional = lambda slot: _shown(bound(slot))  # noqa: E731  # a slot without a bound reference is not there, as the record is built only where all are bound
    each = lambda of, build: F.transform(listed(emit, f"$.{of}"), lambda x, i: build(x, lambda f: F.concat(_place(of, i), F.lit(f".{f}")), i))
    ids = lambda x, key: listed(x, f"$.{key}")
    plain = lambda x, *keys: {k: _get(x, k) for k in keys}
    statement_ids, mention_ids = "_statement_ids", "_mention_ids"

    issues = lambda x, at: F.transform(listed(x, "$.unresolved"), lambda y, j: _object(reason=_get(y, "reason"), evidence=needed(F.concat(at("unresolved["), j.cast("string"), F.lit("].evidence")))))
    statements = each("statements", lambda x, at, i: _object(
        **plain(x, "id", "kind", "subject", "topic", "polarity"), evidence=needed(at("evidence")), section_heading=F.get(bound(at("evidence")), F.lit(0))["section_heading"],
        modality_evidence=optional(at("modality_evidence")), polarity_evidence=optional(at("polarity_evidence")),
        condition_ids=ids(x, "condition_ids"), fact_ids=ids(x, "fact_ids"), unresolved=issues(x, at)))
    groups = each("relations.groups", lambda x, at, i: _object(**plain(x, "id", "operator"), members=ids(x, "members"), evidence=optional(at("evidence"))))
    conditions = each("relations.conditions", lambda x, at, i: _object(
        **plain(x, "id", "kind"), evidence=needed(at("evidence")), statement_ids=ids(x, "statement_ids"), fact_ids=ids(x, "fact_ids")))
    examples = each("relations.example_sets", lambda x, at, i: _object(
        **plain(x, "id", "parent_statement_id", "exhaustive"), mention_ids=ids(x, "mention_ids"), evidence=optional(at("evidence"))))
    items = each("relations.tracks.items", lambda x, at, i: _object(
        **plain(x, "id", "open"), name_evidence=needed(at("name_evidence")), evidence=needed(at("evidence")),
        statement_ids=_pruned(ids(x, "statement_ids"), statement_ids), mention_ids=_pruned(ids(x, "mention_ids"), mention_ids)))
    tracks = _get(emit, "relations.tracks")
    tracks = F.when(is_object(tracks), _object(selection=_get(tracks, "selection"), selection_evidence=optional(F.lit("relations.tracks.selection_evidence")), items=items))

    def entry(x, at, i):
        scope = _get(x, "scope")
        scoped = F.to_variant_object(_object(kind=_get(scope, "kind"), evidence=optional(at("scope.evidence"))))
        cites = _object(value=needed(at("evidence.value")), **{a: optional(at(f"evidence.{a}")) for a in ASPECTS})
        return _object(**plain(x, "id", "family", "date_kind", "component"), statement_ids=ids(x, "statement_ids"), condition_ids=ids(x, "condition_ids"),
                       scope=F.when(is_object(scope), scoped).otherwise(scope), evidence=cites, derived=F.coalesce(F.to_variant_object(F.try_element_at("derived", i)), _unread()))

    def presence(key, family=None):
        at = f"facts.presence.{key}"
        state, evidence = _get(emit, f"{at}.state"), optional(F.lit(f"{at}.evidence"))
        if family:
            claimed = text(state) == "stated"
            owned = F.when(F.array_contains(F.col("_families"), family), "stated").when(claimed & evidence.isNotNull(), "unresolved").when(claimed, "none_found")
            return _object(state=F.coalesce(owned.cast("variant"), state), evidence=evidence)
        return _object(state=state, evidence=evidence, polarity=_get(emit, f"{at}.polarity"), polarity_evidence=optional(F.lit(f"{at}.polarity_evidence")))

    def stated(key, polarity):
        at = f"facts.presence.{key}"
        told = (text(_get(emit, f"{at}.state")) == "stated") & (text(_get(emit, f"{at}.polarity")) == polarity)
        return F.coalesce(told & optional(F.lit(f"{at}.evidence")).isNotNull(), F.lit(False))

    authorization = _object(
        sponsorship=F.when(stated("sponsorship", "positive"), "yes").when(stated("sponsorship", "negative"), "no").otherwise("undeclared"),
        citizenship_required=stated("citizenship", "positive"), evidence=_object(**{f: optional(F.lit(f"facts.presence.{f}.evidence")) for f in AUTHORIZATION}))
    surface = lambda x: F.coalesce(text(x, "$.surface"), F.lit(""))
    mentions = each("mentions", lambda x, at, i: _object(
        **plain(x, "id", "surface", "role", "type"), evidence=_one(F.get(bound(at("evidence")), F.lit(0))),
        statement_ids=_pruned(ids(x, "statement_ids"), statement_ids), normalized_key=normalized_key(surface(x))))
    areas = each("areas", lambda x, at, i: _object(**plain(x, "id", "name", "kind"), statement_ids=ids(x, "statement_ids"), evidence=optional(at("evidence"))))
    accounting = each("block_accounting", lambda x, at, i: _object(
        **plain(x, "block_id", "disposition", "exclusion_reason"), ref_ids=ids(x, "ref_ids"), evidence=optional(at("evidence"))))
    lost = F.flatten(F.concat(
        F.flatten(each("relations.tracks.items", lambda x, at, i: F.array(
            _lost(at("statement_ids"), ids(x, "statement_ids"), statement_ids), _lost(at("mention_ids"), ids(x, "mention_ids"), mention_ids)))),
        each("mentions", lambda x, at, i: _lost(at("statement_ids"), ids(x, "statement_ids"), statement_ids))))
    return {
        "document": _object(document_hash=F.col("document_hash"), normalizer_version=F.col("normalizer_version"), annotation_version="blocks/1"),
        "source_assessment": _object(usability=_get(emit, "source_assessment.usability"), note=_get(emit, "source_assessment.note"), evidence=optional(F.lit("source_assessment.evidence"))),
        "statements": statements, "relations": _object(groups=groups, conditions=conditions, example_sets=examples, tracks=tracks),
        "facts": _object(presence=_object(**{k: presence(k, f) for f, k in PRESENCE_KEY.items()}, **{f: presence(f) for f in AUTHORIZATION}), entries=each("facts.entries", entry)),
        "mentions": mentions, "areas": areas, "block_accounting": accounting, "authorization": authorization, "dropped_links": lost}


def _record(parts: list[str], extraction: dict[str, Column], candidate_hash: Column | str, quality: Column | None) -> Column:
    """The record of a row whose parts are columns, under a hash; dropped links are told only if there are any."""
    of = lambda **more: F.to_variant_object(_object(**extraction, candidate_hash=candidate_hash, **more))
    told = F.when(F.size("dropped_links") > 0, of(dropped_links=F.col("dropped_links"))).otherwise(of())
    return _object(**{n: F.col(n) for n in parts if n != "dropped_links"}, extraction=told, quality=quality)


def assemble(extractions: DataFrame, extraction: dict[str, Column]) -> DataFrame:
    """From extractions (doc_id, emit: JSON, text, document_hash, normalizer_version) and the fields of a record's `extraction` (its model, versions,
    time and parent, as columns of that table): doc_id, record (VARIANT, null if there are errors), candidate_hash, errors."""
    parsed = F.try_parse_json(F.col("_json"))
    e = extractions.withColumnRenamed("emit", "_json").withColumn("emit", F.when(F.col("_json").rlike(r"^[ \t\n\r]*\{"), parsed))
    bound = written(_bound(e.select("doc_id", "emit", F.coalesce("text", F.lit("")).alias("text"))), "bound")
    by_slot, facts = _by_slot(bound), _facts(bound)
    whole = e.drop("text").join(by_slot, "doc_id", "left").join(facts, "doc_id", "left")
    whole = whole.withColumn("bound", F.coalesce("bound", F.from_json(F.lit("{}"), by_slot.schema["bound"].dataType)))
    odd = F.col("_json").contains("\\u") | F.regexp_replace("_json", "[ -~]+", "").rlike(INVISIBLE)  # few characters are left to be looked at one by one
    unseen = _character_errors(F.when(F.col("emit").isNotNull() & odd, F.col("_json")))
    none = F.array().cast("array<string>")
    shape = F.when(F.col("emit").isNull(), F.array(F.lit("emit: not an object"))).otherwise(none)
    whole = whole.withColumn("errors", F.concat(shape, F.coalesce(unseen, none), F.coalesce("errors", none)))
    parts = {f"_{n}": c for n, c in _parts(F.col("emit")).items()}
    names, told = [n[1:] for n in parts], {f"_given_{k}": c for k, c in extraction.items()}
    good = F.size("errors") == 0
    built = whole.withColumns(_known(F.col("emit")) | told).select("doc_id", "errors", *told, F.when(good, F.struct(*[c.alias(n[1:]) for n, c in parts.items()])).alias("_r"), F.col("emit"))
    built = built.select("doc_id", "errors", *told, *[F.col(f"_r.{n}").alias(n) for n in names], F.when(good, _get(F.col("emit"), "source_assessment.usability")).alias("_source"))
    given = {k: F.col(f"_given_{k}") for k in extraction}
    # the parts are made once; the hash is that of the record without its quality and its own hash
    shadow = F.to_json(_record(names, given, "", None), {"ignoreNullFields": "false"})
    hashed = built.withColumn("candidate_hash", F.when(good, F.sha2(shadow, 256)))
    quality = _object(source=F.col("_source"), evidence="pass", semantics="not_checked", completeness="not_checked", sampling="not_requested", human_review="none", search_eligible=F.lit(False))
    return hashed.select("doc_id", F.when(good, F.to_variant_object(_record(names, given, F.col("candidate_hash"), quality))).alias("record"), "candidate_hash", "errors")
