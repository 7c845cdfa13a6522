"""Checks of a record against its document beyond single references: coverage, accounting, relations, statements and usability.

Tables as in records.py; blocks are those of texts.annotate (doc_id, block_id, text, start, end). Every check returns rows
(doc_id, path, code), so a record's verification is their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import case_fold

#: Patterns and vocabularies of the contract.
HEADING = r"^\s*(?:#{1,6}\s+\S|\*\*[^*].*\*\*\s*$|__[^_].*__\s*$)"
TRAILING_MARKS = r"[*_`#>\s]+$"
SENTENCE_END = r"[.!?:;]$"
STARTS_LOWER = r"^\s*[a-z]"
REQUIREMENT_LANGUAGE = r"(?i)\b(must|requir\w*|minimum|at least|only candidates|need to|proficien\w*|fluen\w*)\b"
MODAL_TERMS = ["must", "required", "require", "preferred", "prefer", "ideally", "plus", "nice to have", "bonus", "minimum", "at least", "strongly"]
IMPORTANCE_KINDS = ["qualification", "employment_constraint", "hiring_policy"]
EVIDENCED_IMPORTANCE = ["required", "preferred", "not_required", "ambiguous"]
SPONSORSHIP = ["yes", "no", "undeclared"]


def block_number(block_id: Column) -> Column:
    return F.substring(block_id, 2, 20).cast("int")


def coverage_units(blocks: DataFrame) -> DataFrame:
    """blocks with what else covers each: blocks of the same copies (null: blank of words), of the same chain of a wrapped sentence, and,
    for a lead-in, of the rest of its section (headings) or of its run (lines that end in a colon).

    Units are equalities of keys, never lists of pairs, so a section or a line that occurs very often costs nothing more."""
    order = Window.partitionBy("doc_id").orderBy("n")
    x = blocks.withColumn("n", block_number(F.col("block_id")))
    bare = F.regexp_replace("text", TRAILING_MARKS, "")
    x = x.withColumns({"is_heading": F.col("text").rlike(HEADING), "_bare": bare, "copies": F.nullif(F.trim(F.lower(F.regexp_replace("text", r"(?U)\W+", " "))), F.lit(""))})
    x = x.withColumn("is_lead_in", F.col("is_heading") | F.col("_bare").endswith(":"))
    joined = ~F.lag("is_lead_in").over(order) & ~F.col("is_heading") & ~F.lag("_bare").over(order).rlike(SENTENCE_END) & F.col("text").rlike(STARTS_LOWER)
    count = lambda c: F.sum(c.cast("int")).over(order)
    x = x.withColumn("_parts", ~F.coalesce(joined, F.lit(False)))
    return x.withColumns({"chain": count(F.col("_parts")), "section": count(F.col("is_heading")), "run": count(F.col("is_lead_in"))}).drop("_bare", "_parts")


def covered_blocks(blocks: DataFrame, cited: DataFrame) -> DataFrame:
    """doc_id, block_id, is_cited, is_covered: whether a cited block (doc_id, block_id) stands in the block's unit."""
    marked = cited.select("doc_id", "block_id").distinct().withColumn("_c", F.lit(1))
    x = coverage_units(blocks).join(marked, ["doc_id", "block_id"], "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    within = lambda c: F.sum("_c").over(Window.partitionBy("doc_id", c)) > 0
    covered = (F.col("_c") > 0) | (F.col("copies").isNotNull() & within("copies")) | within("chain")
    covered = covered | (F.col("is_heading") & within("section")) | (F.col("is_lead_in") & ~F.col("is_heading") & within("run"))
    return x.select("doc_id", "block_id", (F.col("_c") > 0).alias("is_cited"), covered.alias("is_covered"))


def accounting_errors(blocks: DataFrame, accounting: DataFrame, evidence: DataFrame) -> DataFrame:
    """accounting: doc_id, block_id, disposition, exclusion_reason, ref_ids; evidence: doc_id, ref_id, block_id (what each object quotes)."""
    units = coverage_units(blocks)
    own = accounting.join(units.select("doc_id", "block_id", "text", "n", "copies", "chain", "section", "run", "is_heading", "is_lead_in"), ["doc_id", "block_id"], "left")
    needs = F.col("disposition") == "statements"
    no_refs = F.coalesce(F.size("ref_ids"), F.lit(0)) < 1
    path = F.concat(F.lit("block_accounting/"), "block_id")
    simple = own.select("doc_id", path.alias("path"), F.explode(F.array_compact(F.array(
        F.when(F.col("n").isNull(), "unknown_block"),
        F.when((F.col("disposition") == "excluded") == F.col("exclusion_reason").isNull(), "exclusion_reason_missing"),
        F.when(needs & no_refs, "refs_missing"),
        F.when((F.col("disposition") == "excluded") & F.col("text").rlike(REQUIREMENT_LANGUAGE), "exclusion_requirement_language"),
        F.when((F.col("disposition") == "context") & F.col("text").rlike(REQUIREMENT_LANGUAGE), "context_requirement_language"),
    ))).alias("code"))
    asked = own.where(needs & ~no_refs & F.col("n").isNotNull())
    quoted = evidence.join(units.select("doc_id", "block_id", F.col("n").alias("_n"), F.col("copies").alias("_copies"), F.col("chain").alias("_chain"), F.col("section").alias("_section"), F.col("run").alias("_run")), ["doc_id", "block_id"]).drop("block_id")
    pairs = asked.select("*", F.explode("ref_ids").alias("ref_id")).join(quoted, ["doc_id", "ref_id"], "left")
    covers = F.coalesce((F.col("_n") == F.col("n")) | F.coalesce(F.col("_copies") == F.col("copies"), F.lit(False)) | (F.col("_chain") == F.col("chain")) | (F.col("is_heading") & (F.col("_section") == F.col("section"))) | (F.col("is_lead_in") & ~F.col("is_heading") & (F.col("_run") == F.col("run"))), F.lit(False))
    empty = pairs.groupBy("doc_id", "block_id").agg(F.max(covers).alias("_any")).where("not _any").select("doc_id", path.alias("path"), F.lit("coverage_unevidenced").alias("code"))
    missing = blocks.join(accounting.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti").select("doc_id", path.alias("path"), F.lit("block_unaccounted").alias("code"))
    return simple.unionByName(empty).unionByName(missing)


def connective_errors(groups: DataFrame) -> DataFrame:
    """groups: doc_id, group_id, operator, evidence (array). An asserted connective cites the document."""
    asserted = F.col("operator").isin("all_of", "any_of") & (F.coalesce(F.size("evidence"), F.lit(0)) < 1)
    return groups.where(asserted).select("doc_id", F.concat(F.lit("groups/"), "group_id").alias("path"), F.lit("connective_evidence_missing").alias("code"))


def statement_errors(statements: DataFrame) -> DataFrame:
    """statements: doc_id, statement_id, kind, importance, importance_evidence, proficiency, proficiency_evidence: importance goes with the kinds that rule."""
    ruled, none = F.col("kind").isin(IMPORTANCE_KINDS), lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    codes = F.array_compact(F.array(
        F.when(ruled & F.col("importance").isNull(), "importance_missing"), F.when(~ruled & F.col("importance").isNotNull(), "importance_unexpected"),
        F.when(F.col("proficiency").isNotNull() & none("proficiency_evidence"), "proficiency_evidence_missing"), F.when(F.col("importance").isin(EVIDENCED_IMPORTANCE) & none("importance_evidence"), "importance_evidence_missing"),
    ))
    return statements.select("doc_id", F.concat(F.lit("statements/"), "statement_id").alias("path"), F.explode(codes).alias("code"))


def heading_errors(statements: DataFrame, headed: DataFrame) -> DataFrame:
    """statements: doc_id, statement_id, block_id (of the first evidence), section_heading; headed: doc_id, block_id, section_heading as derived."""
    derived = headed.select("doc_id", "block_id", F.col("section_heading").alias("_derived"))
    x = statements.join(derived, ["doc_id", "block_id"], "left").where(~F.col("section_heading").eqNullSafe(F.col("_derived")))
    return x.select("doc_id", F.concat(F.lit("statements/"), "statement_id").alias("path"), F.lit("section_heading_mismatch").alias("code"))


def usability_codes(usability: Column, has_evidence: Column, n_blocks: Column, n_statements: Column, n_facts: Column) -> Column:
    """The source's stated usability against the source and what was taken from it."""
    return F.array_compact(F.array(
        F.when((usability == "empty") != (n_blocks == 0), "usability_conflict"),
        F.when((n_blocks > 0) & usability.isin("partial", "placeholder", "unsupported") & ~has_evidence, "evidence_required"),
        F.when(usability.isin("empty", "placeholder") & (n_statements + n_facts > 0), "empty_with_content"),
    ))


def verification(errors: list[DataFrame], documents: DataFrame) -> DataFrame:
    """All documents with the number of their errors, the distinct codes in order, and pass or fail."""
    found = errors[0]
    for e in errors[1:]:
        found = found.unionByName(e)
    per = found.groupBy("doc_id").agg(F.count("*").alias("n_errors"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    x = documents.select("doc_id").join(per, "doc_id", "left")
    return x.select("doc_id", F.coalesce("n_errors", F.lit(0)).cast("long").alias("n_errors"), F.coalesce("codes", F.lit("")).alias("codes"), F.when(F.col("n_errors").isNull(), "pass").otherwise("fail").alias("status"))


def quotes_modality(text: Column) -> Column:
    """Whether a quote holds a modal term; null is no quote."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, MODAL_TERMS)), lambda t: lowered.contains(t))


def authorization_row(profile: Column) -> Column:
    """From a stored JSON profile: (sponsorship, citizenship_required), null unless both are of the vocabulary."""
    v = F.try_parse_json(profile)
    sponsorship, citizen = F.try_variant_get(v, "$.authorization.sponsorship", "string"), F.try_variant_get(v, "$.authorization.citizenship_required", "variant")
    written = F.schema_of_variant(citizen) == "BOOLEAN"  # not a string that reads as one
    return F.when(sponsorship.isin(SPONSORSHIP) & written, F.struct(sponsorship.alias("sponsorship"), F.try_variant_get(citizen, "$", "boolean").alias("citizenship_required")))


def canonical_decimal(number: Column) -> Column:
    """A decimal's text without an exponent or closing zeros, so equal numbers have one spelling."""
    text = number.cast("decimal(38,10)").cast("string")
    return F.when(text.rlike(r"^-?0*\.?0*$"), "0").otherwise(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


#: Control, format, private, unassigned and surrogate characters, but for line feed and tab; the JVM's Unicode tables decide.
INVISIBLE = r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}\p{Cs}&&[^\n\t]]"


def invisible_count(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, INVISIBLE, "")), F.lit(0))


def normalized_key(surface: Column) -> Column:
    """Case-folded and trimmed."""
    return F.regexp_replace(case_fold(surface), r"(?U)^\s+|\s+$", "")


#: Phrases that only boilerplate holds.
BOILERPLATE = [
    "equal opportunity employer", "equal employment opportunity", "affirmative action", "without regard to race", "sexual orientation, gender identity",
    "protected veteran", "reasonable accommodation", "privacy statement", "privacy notice", "privacy policy", "candidate privacy", "e-verify", "recruiting fee",
    "recruitment fee", "fraudulent", "phishing", "will never ask", "fair chance", "arrest and conviction",
]


def out_of_scope(block: Column) -> Column:
    """A block of boilerplate, unless it also has the language of a requirement. Null is no block."""
    lowered = F.lower(F.coalesce(block, F.lit("")))
    return F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda t: lowered.contains(t)) & ~F.coalesce(block, F.lit("")).rlike(REQUIREMENT_LANGUAGE)
